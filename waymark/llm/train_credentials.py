"""Train the credential CRF on generated lines: ``python -m waymark.llm.train_credentials`` writes credentials.json.

No corpus row is used: names, values and lines are drawn from the generators below. Each line is text with the
secret characters between \\x01 and \\x02.
"""

from __future__ import annotations

import base64
import random
import sys
from collections.abc import Callable

from waymark.llm.credentials import WEIGHTS, Lexer, context_features, joined, own_features, token_starts
from waymark.llm.crf import B, Crf, I, O, train

SECRET_KEYS = (
    "password passwd passwort pwd pass passphrase senha contrasena mot_de_passe secret client_secret token access_token auth_token refresh_token"
    " bot_token deploy_token session_jwt bearer api_key apikey secret_key private_key signing_key hmac_key encryption_key master_key aws_secret_access_key"
    " auth_header authorization proxy_auth webhook_secret login_secret pgpass root_pw smtp_pwd admin_pass keystore_pass db_password credential service_token"
).split()
ADDRESS_KEYS = "dsn conn database_url broker_url cache_uri upstream mirror connection endpoint webhook_url".split()
HASH_KEYS = "checksum etag sha256 sha512 commit build_id integrity digest md5 revision fingerprint".split()
PUBLIC_KEYS = "public_key public_cert public_jwk cert_pub".split()
META_KEYS = "token_separator token_kind password_field secret_scope key_column max_tokens token_count key_bindings secret_name password_policy token_stream auth_mode api_key_header".split()
PLAIN_KEYS = "channel ledger limit retries region bucket title color path target version window width mode theme locale owner queue topic".split()
WORDS = "callers pass a fresh row keep the order of items see notes fall back to last entry may be empty cheap check before walk rows arrive late".split()
SYL = "ba bra da dan de dol fa fen fi ga gar go hul jor ka ko la lem lu ma mir na nor pa po qua ri ru sa sor su ta tis tor ul va vel vi wen xo yar zo zu".split()
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


class Source:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def name(self, lo: int = 2, hi: int = 4) -> str:
        return "".join(self.r.choice(SYL) for _ in range(self.r.randint(lo, hi)))

    def chars(self, n: int, pool: str = ALNUM) -> str:
        return "".join(self.r.choice(pool) for _ in range(n))

    def password(self) -> str:
        r = self.r
        k = r.random()
        if k < 0.35:
            return self.name(3, 6) + str(r.randint(10, 99))
        if k < 0.65:
            return self.name().capitalize() + r.choice("_.-!") + self.name() + str(r.randint(100, 9999)) + r.choice(["", "!", "*"])
        n = r.randint(8, 18)
        return self.chars(1) + self.chars(n, ALNUM * 3 + "!*^-+_.%&#~") + self.chars(1)

    def b64(self, n: int) -> str:
        return base64.b64encode(self.r.randbytes(n)).decode()

    def jwt(self) -> str:
        enc = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
        return f"{enc('{"alg":"HS256","typ":"JWT"}')}.{enc(f'{{"sub": "{self.name()}", "n": {self.r.randint(1, 999999)}}}')}.{self.chars(self.r.randint(20, 43), ALNUM + '-_')}"

    def issued(self) -> str:
        r = self.r
        return r.choice(
            [
                lambda: r.choice(["ghp_", "gho_", "ghs_", "ghu_"]) + self.chars(36),
                lambda: "glpat-" + self.chars(20, ALNUM + "-_"),
                lambda: "npm_" + self.chars(r.choice([24, 36])),
                lambda: r.choice(["xoxb-", "xoxp-"]) + self.chars(24),
                lambda: r.choice(["sk_live_", "rk_live_"]) + self.chars(24),
                lambda: r.choice(["AKIA", "ASIA"]) + self.chars(16, ALNUM[:26] + "234567"),
                self.jwt,
            ]
        )()

    def raw_key(self) -> str:
        return self.r.choice([lambda: self.chars(32, "0123456789abcdef"), lambda: self.chars(40, "0123456789abcdef"), lambda: self.b64(24), lambda: self.chars(32, ALNUM + "+/"), lambda: self.b64(32), lambda: self.chars(32)])()

    def host(self) -> str:
        return f"{self.name()}.{self.r.choice(['example', 'invalid', 'test', 'com', 'internal'])}"

    def address(self) -> str:
        r, user = self.r, self.r.choice(["", "svc_", "app-"]) + self.name()
        secret = self.chars(r.randint(8, 14)) if r.random() < 0.7 else self.name() + "%40" + self.chars(7)
        return r.choice(
            [
                lambda: f"{r.choice(['postgres', 'mysql', 'redis', 'amqp', 'https', 'mongodb'])}://{user}:\1{secret}\2@{self.host()}{r.choice(['', ':5432', ':6379'])}/{r.choice(['0', self.name()])}",
                lambda: f"https://{user}:\1{secret}\2@{self.host()}/{self.name()}",
                lambda: f"Server={self.host()};Uid={user};Pwd=\1{self.chars(12)}\2;",
                lambda: f"DefaultEndpoint=https;AccountName={self.name()};AccountKey=\1{self.b64(32)}\2",
                lambda: f"https://{self.host()}/hook?team={self.name()}&sig=\1{self.chars(28)}\2",
            ]
        )()

    def secret(self) -> str:
        r = self.r
        k = r.random()
        if k < 0.3:
            return f"\1{self.password()}\2"
        if k < 0.6:
            return f"\1{self.issued()}\2"
        if k < 0.75:
            return f"\1{self.raw_key()}\2"
        if k < 0.85:
            return f"Basic \1{base64.b64encode(f'{self.name()}:{self.password()}'.encode()).decode()}\2"
        if k < 0.9:
            return f"Bearer \1{self.chars(32)}\2"
        return self.address()

    def blank(self, key: str) -> str:
        r, up = self.r, key.upper()
        return r.choice(
            [f"YOUR_{up}", f"<your-{key.replace('_', '-')}>", "x" * 16, "*" * 16, "[REDACTED]", "REPLACE_ME", "todo-fill-in", "changeme", "", f"${{{up}}}", f"{{{{ vault.{key} }}}}", f"%({key})s", "postgres://USER:PASSWORD@HOST/DB", "example", "dummy", "********", "xxx", f"$({up})", "<redacted>", "***"]
        )

    def plain(self) -> str:
        r = self.r
        return r.choice(["comma", "team", "identifier", "4096", "input_password", "user_id", self.name(), f"{self.name()}_{self.name()}", f"./{self.name()}/{self.name()}", f"https://{self.host()}:8443/{self.name()}", "utf-8", "true", f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"{self.name()}-{r.randint(1, 99)}", " ".join(r.sample(WORDS, 4)), f"{self.host()}"])

    def digest(self) -> str:
        h = lambda n: self.chars(n, "0123456789abcdef")
        return self.r.choice([lambda: h(40), lambda: h(64), lambda: h(32), lambda: "sha512-" + self.b64(self.r.choice([42, 64])), lambda: f"{h(8)}-{h(4)}-{h(4)}-{h(4)}-{h(12)}", lambda: "sha256:" + h(64)])()

    def public(self) -> str:
        return self.r.choice([lambda: "ssh-ed25519 AAAAC3" + self.b64(45), lambda: "-----BEGIN PUBLIC KEY-----\\nMIIB" + self.b64(60), lambda: "ssh-rsa AAAAB3" + self.b64(60), lambda: "-----BEGIN CERTIFICATE-----\\nMIID" + self.b64(60)])()

    def private(self) -> str:
        return f"-----BEGIN {self.r.choice(['', 'RSA ', 'EC ', 'OPENSSH '])}PRIVATE KEY-----\\n\1MII{self.b64(75)}\2"

    def key(self, base: str, tail: bool = False) -> tuple[str, str]:
        """(styled name, snake name); perhaps with words before or after."""
        r, parts = self.r, base.split("_")
        if r.random() < 0.4 and not tail:
            parts = [self.name(), *parts]
        if tail:
            parts = [*parts, self.name()]
        snake = "_".join(parts)
        style = r.choice(["snake", "UPPER", "camel"])
        return {"snake": snake, "UPPER": snake.upper(), "camel": parts[0] + "".join(p.capitalize() for p in parts[1:])}[style], snake

    def assign(self, key: str, value: str) -> str:
        r = self.r
        q = r.choice("\"\"\"'")
        if r.random() < 0.08 and len(value) > 12 and "\\" not in value and "PRIVATE" not in value:
            cut = r.randint(3, len(value) - 3)
            value = f"{value[:cut]}{q} + {q}{value[cut:]}"
        return r.choice(
            [
                f"{key} = {q}{value}{q}", f"{key}: {q}{value}{q}", f"const {key} = {q}{value}{q};", f"export const {key} = {q}{value}{q};", f"let {key} = {q}{value}{q};", f"var {key} = {q}{value}{q}",
                f'pub const {key.upper()}: &str = "{value}";', f'private static final String {key.upper()} = "{value}";', f'"{key}": "{value}",', f"{key}={value}", f"{key}: {value}", f"export {key}={value}", f'{key} := "{value}"', f"self.{key} = {q}{value}{q}",
            ]
        )

    def comment(self, body: str) -> str:
        return f"{self.r.choice(['# TODO: ', '// TODO: ', '// FIXME: ', '# FIXME: ', '// ', '# ', ''])}{body}"

    def found(self) -> str:
        r = self.r
        key, snake = self.key(r.choice(SECRET_KEYS))
        pw = f"\1{self.password()}\2"
        host, user = self.host(), self.name()
        forms: list[Callable[[], str]] = [
            *[lambda: self.assign(key, self.secret())] * 9,
            *[lambda: self.assign(self.key(r.choice(ADDRESS_KEYS))[0], self.address() if r.random() < 0.8 else f"\1{self.issued()}\2")] * 3,
            lambda: self.assign(self.key(r.choice(PLAIN_KEYS))[0], f"\1{self.issued()}\2" if r.random() < 0.5 else self.address()),
            lambda: self.assign(self.key(r.choice(["pem", "pem_key", "tls_key", "key", *PLAIN_KEYS]))[0], self.private()),
            lambda: self.comment(f"old run used --{snake.replace('_', '-')}={self.secret() if r.random() < 0.5 else pw}"),
            lambda: self.comment(f"old run used --{r.choice(ADDRESS_KEYS).replace('_', '-')}={self.address()}"),
            lambda: self.comment(f"remove before release: {snake}={self.secret() if r.random() < 0.6 else pw}"),
            lambda: self.comment(f"remove before release: {self.key(r.choice(ADDRESS_KEYS))[1]}={self.address()}"),
            lambda: self.comment(f"mysql -h {host} -u root -p\1{self.chars(r.randint(11, 13))}1\2"),
            lambda: self.comment(f"curl -u {user}:{pw} https://{host}/v1/{self.name()}"),
            lambda: self.comment(f"rotate the {self.name()} login, still {user} / {pw}"),
            lambda: self.comment(f"Zugang {user}, Passwort lautet {pw}"),
            lambda: self.comment(f"password for {user} is {pw}"),
            lambda: f"- [{self.name()} console](https://{user}:\1{self.chars(12)}\2@{host}/{self.name()})",
            lambda: f"## Staging access ({snake}: {self.secret()})",
            lambda: f"{self.name()} = connect(user=\"svc_{user}\", {r.choice(['auth', 'pwd', 'passwd', 'secret', 'password'])}=\"{pw}\")",
            lambda: f"const {self.name()} = connect({{ user: 'svc_{user}', {r.choice(['pass', 'password', 'apiKey', 'pwd', 'secret'])}: '{pw}' }});",
            lambda: f"{r.choice(['sensitive filename', 'sensitive directory name'])}: first line {snake.upper()}={self.secret()}",
            lambda: f"{r.choice(['sensitive filename', 'sensitive directory name', 'name looks sensitive'])} (matched '{r.choice([self.address(), chr(1) + self.issued() + chr(2)])}')",
            lambda: f"private key or certificate-like extension; header Authorization: Bearer \1{self.chars(32)}\2",
            lambda: f"{snake}: {self.secret()}",
            lambda: self.path(f"\1{self.issued() if r.random() < 0.6 else self.chars(20)}\2" if r.random() < 0.5 else f"pw={pw}"),
            lambda: self.path(f"svc:\1{self.chars(11)}\2@{host}"),
            lambda: self.path(f"\1{r.choice(['AKIA', 'ASIA', 'sk_live_', 'ghp_', 'xoxb-', 'npm_'])}{self.chars(20, ALNUM[:26] + '234567')}\2"),
        ]
        return r.choice(forms)()

    def minified(self) -> str:
        r = self.r
        c = lambda: r.choice(ALNUM[:52]) + self.chars(r.randint(0, 3))
        forms = [
            lambda: f"!function(){{{c()}.{c()}=[{r.randint(1, 99)},{r.randint(1, 99)}]}}();",
            lambda: f"{c()}.{c()}=function(n){{for(var i=0;i<n;i++)this.{c()}(i)}};",
            lambda: f"var {c()}={{{c()}:{r.randint(1, 9)},{c()}:!0}};",
            lambda: f"function {c()}(e,t){{return e?t.{c()}(e,{r.randint(1, 99)}):void 0}}",
            lambda: f"for(let {c()}=0;{c()}<{r.randint(1, 99)};)",
            lambda: f"{c()}=(e,t)=>{{e.{c()}=t?'{c()}':null}},",
        ]
        return "".join(r.choice(forms)() for _ in range(r.randint(2, 5)))

    def path(self, part: str) -> str:
        r = self.r
        if "/" in part:
            part = part.replace("/", "A").replace("+", "b")
        stem = r.choice(["", "dump-", "mirror_", "old-", ""]) + part
        return f"{self.name()}-{self.name()}-{r.randint(1, 300)}/{r.choice(['secrets', 'backups', 'tmp', 'ops/dump', f'secrets/{part}'])}/{stem}.{r.choice(['env', 'pem', 'key', 'txt'])}"

    def clean(self) -> str:
        r = self.r
        key, snake = self.key(r.choice(SECRET_KEYS + ADDRESS_KEYS))
        up = snake.upper()
        q = '"'
        forms: list[Callable[[], str]] = [
            *[lambda: self.assign(key, self.blank(snake))] * 5,
            *[lambda: self.assign(self.key(r.choice(META_KEYS), tail=r.random() < 0.7)[0], self.plain())] * 3,
            *[lambda: self.assign(self.key(r.choice(HASH_KEYS), tail=r.random() < 0.7)[0], self.digest())] * 4,
            *[lambda: self.assign(self.key(r.choice(PUBLIC_KEYS), tail=True)[0], self.public())] * 3,
            *[lambda: self.assign(self.key(r.choice(PLAIN_KEYS))[0], self.plain())] * 3,
            lambda: self.assign(self.key(r.choice(PLAIN_KEYS))[0], self.digest()) if r.random() < 0.15 else f"{self.name()}: {r.randint(1, 4000)}",
            lambda: f"{key} = {r.choice([f'os.environ[{q}{up}{q}]', f'os.getenv({q}{up}{q})', f'get_secret({q}{snake}{q})', f'vault.read({q}{snake}{q})', f'getpass({q}{snake}: {q})', f'prompt({q}password: {q})', f'process.env.{up}', f'readSecret({q}{snake}{q})', 'None', 'null', 'undefined', f'config.{snake}', f'args.{snake}', f'settings[{q}{snake}{q}]'])}",
            lambda: f"pub const {up}: &str = env!({q}{up}{q});",
            lambda: f"private static final String {up} = System.getenv({q}{up}{q});",
            lambda: self.comment(f"{snake}: see the {self.name()} vault"),
            lambda: self.comment(f"secret rotation for {self.name()} breaks when token == null"),
            lambda: self.comment(f"drop token={{token}} from the {self.name()} log line"),
            lambda: self.comment(f"password is read from the prompt, never store it in {self.name()}"),
            lambda: self.comment(f"https://{self.host()}:8443/{self.name()}@{r.randint(1, 9)}.{r.randint(0, 9)}"),
            lambda: self.comment(f"ask {self.name()}@{self.host()} about {self.name()} / {self.name()}"),
            lambda: self.comment(" ".join(r.sample(WORDS, r.randint(3, 7)))),
            lambda: f"\"node_modules/{self.name()}-{r.randint(0, 40)}\": {{ \"version\": \"{r.randint(0, 9)}.{r.randint(0, 9)}.1\", \"integrity\": \"sha512-{self.b64(64)}\" }},",
            lambda: f"## {r.choice(['Token budget', 'Password policy', 'Key bindings', 'Render the'])} for {self.name()}",
            lambda: f"- [{self.name()}](docs/{self.name()}.md)",
            lambda: f"- [{self.name()} console](https://{self.host()}/{self.name()})",
            lambda: f"def {self.name()}_token_{self.name()}(self, {self.name()}, all_{self.name()}=None):",
            lambda: f"public int {self.name()}Token(String {self.name()}In, List<String> all{self.name().capitalize()}) {{",
            lambda: f"export function {self.name()}{r.randint(1, 999):03d}(buf: any) {{ return buf[{r.randint(1, 300)}]; }}",
            lambda: f"pub fn {self.name()}_{self.name()}({self.name()}_in: &str, all_{self.name()}: &[String]) -> usize {{",
            lambda: f"import {{ {self.name()}Token }} from \"./{self.name()}/{self.name()}\";",
            lambda: f"from auth.{self.name()} import {self.name()}_key",
            *[self.minified] * 2,
            lambda: f"{r.choice(['variable', 'function', 'method', 'struct', 'css_class'])} {self.name()}_{r.choice(['token', 'key', self.name()])}",
            lambda: f"data:image/png;base64,{self.b64(60)}",
            lambda: f"{self.name().upper()} = [{', '.join(hex(r.randint(0, 255)) for _ in range(12))}]",
            lambda: r.choice(["sensitive filename", "sensitive directory name", "private key or certificate-like extension", "name looks sensitive", "sensitive filename (password=********)", "sensitive filename: first line TOKEN=${TOKEN}", f"sensitive directory name; sha256 {self.chars(64, '0123456789abcdef')}", "  Sensitive Filename"]),
            lambda: f"{self.name()}-{self.name()}-{r.randint(1, 300)}/{r.choice(['secrets', 'credentials', 'config/secret', 'ops/private_keys', 'docs', 'src/auth'])}/{r.choice([self.name(), 'token_reader', 'secret_santa', 'password_policy', 'key_bindings', '.env', 'credentials', 'id_rsa'])}.{r.choice(['env', 'pem', 'key', 'txt', 'yaml', 'md', 'py', 'p12'])}",
            lambda: f"{self.name()}-{self.name()}-{r.randint(1, 300)}/secrets/{self.chars(40, '0123456789abcdef')}/{r.choice(['password.example', 'token-REDACTED', 'sha256-' + self.chars(64, '0123456789abcdef')])}.key",
        ]
        return r.choice(forms)()


def cut_line(marked: str, width: int = 120) -> str:
    """Cut at the width as stored texts are, marks not counted."""
    plain = marked.replace("\1", "").replace("\2", "")
    if len(plain) <= width:
        return marked
    out, n, inside = [], 0, False
    for ch in marked:
        if ch == "\1":
            inside = True
        elif ch == "\2":
            inside = False
        else:
            if n == width - 1:
                break
            n += 1
        out.append(ch)
    return "".join(out) + ("\2" if inside else "") + "…"


def labelled(marked: str) -> tuple[str, list[bool]]:
    text, mask, inside = [], [], False
    for ch in marked:
        if ch in "\1\2":
            inside = ch == "\1"
        else:
            text.append(ch)
            mask.append(inside)
    return "".join(text), mask


def example(marked: str, lexer: Lexer) -> tuple[list[list[str]], list[int]]:
    text, mask = labelled(marked)
    flat, keep = joined(text)
    if keep is not None:
        mask = [mask[i] for i in keep]
    toks, _, flags, away = lexer.look(flat)
    starts, ctx = token_starts(toks), lexer.context(toks, flags, away)
    labels, last = [], O
    for t, s in zip(toks, starts, strict=True):
        on = mask[s] or mask[s + len(t) - 1]
        last = (I if last != O else B) if on else O
        labels.append(last)
    return [own_features(t) + context_features(c) for t, c in zip(toks, ctx, strict=True)], labels


def lines(n: int, seed: int) -> list[str]:
    src = Source(seed)
    return [cut_line(src.found() if k % 2 else src.clean()) for k in range(n)]


def fit(n: int = 9000, seed: int = 11, epochs: int = 5) -> Crf:
    lexer = Lexer()
    return train([example(m, lexer) for m in lines(n, seed)], epochs=epochs)


if __name__ == "__main__":
    fit(int(sys.argv[1]) if len(sys.argv) > 1 else 9000).save(WEIGHTS)
