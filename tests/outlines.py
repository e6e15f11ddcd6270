"""Own fixtures of the parsed languages: text, and the places that must come out as kind:name@line:col."""

FIXTURES = {
    "rs": (
        '''//! Harbour tools. struct CommentFake;
use std::fmt;
pub const LIMIT: usize = 3;
static mut COUNT: u32 = 0;
/* /* fn nested_fake() {} */ struct NoFake; */
#[derive(Debug)]
pub struct Crane<'a> { name: &'a str }
pub enum Load { Full(u32), Empty }
pub trait Lift { type Out; fn lift(&self) -> u32; fn drop_it(&self) -> u32 { self.lift() } }
type Pair = (u32, u32);
mod inner { pub fn deep() -> &'static str { "fn string_fake() {}" } }
impl<'a> Lift for Crane<'a> {
    type Out = u32;
    fn lift(&self) -> u32 { compute(inner::deep().len() as u32) }
}
fn compute(x: u32) -> u32 { let r = r#"struct RawFake { }"#; x + r.len() as u32 }
''',
        "constant:LIMIT@3:11 variable:COUNT@4:12 struct:Crane@7:12 enum:Load@8:10 trait:Lift@9:11 function:drop_it@9:54 type:Pair@10:6 module:inner@11:5 function:deep@11:20 type:Out@13:10 function:lift@14:8 function:compute@16:4",
        "call:compute@14:29 call:deep@14:44",
    ),
    "js": (
        '''import fs from "fs";
import { a as b } from './x.js';
// class CommentFake {}
const text = "function stringFake() {}", size = 4;
const tpl = `class TplFake { ${size} }`;
const re = /function regexFake\\(/;
class Boat extends Hull {
  static #hidden = 1;
  speed = 2;
  constructor(name) { super(name); this.load(name); }
  get width() { return 1; }
  async load(x) { if (x) { await fetchAll(x); } }
}
function* walk() { yield 1; }
const twice = (x) => x * 2, half = function (x) { return x / 2; };
export default function launch() { return new Boat(twice(2)); }
const api = { run() { return 1; }, stop: () => 0 };
export { launch as start, Boat };
''',
        "import:\"fs\"@1:16 import:'./x.js'@2:24 variable:text@4:7 variable:size@4:42 class:Boat@7:7 method:constructor@10:3 method:width@11:7 method:load@12:9 function:walk@14:11 function:twice@15:7 function:launch@16:25 method:run@17:15 export:launch@18:10 export:Boat@18:27",
        "call:load@10:41 call:fetchAll@12:34 call:twice@16:52 export:launch@18:10 export:Boat@18:27",
    ),
    "ts": (
        '''import type { Hull } from "./hull";
export interface Crane { lift(x: number): void; size: number }
type Load = { weight: number } | null;
const LIMIT: number = 3;
abstract class Base { abstract go(): void; }
export class Boat<T> implements Crane {
  private size: number = 1;
  constructor(private readonly name: string) {}
  lift(x: number): void { this.run<T>(x); check(x); }
  run<U>(x: number): Load { return null; }
}
export const make = async (n: string): Promise<Boat<string>> => new Boat(n);
export function build(): string { return "interface StringFake {}"; }
export { make };
''',
        'import:"./hull"@1:27 interface:Crane@2:18 type:Load@3:6 variable:LIMIT@4:7 class:Boat@6:14 method:constructor@8:3 method:lift@9:3 method:run@10:3 function:make@12:14 function:build@13:17 export:make@14:10',
        "call:check@9:43 export:make@14:10",
    ),
    "tsx": ('import { h } from "x";\nexport function Panel(p: { n: number }) { return <Box n={p.n} />; }\nexport const usePanel = () => load();\nexport { Panel };\n', 'import:"x"@1:19 function:Panel@2:17 function:usePanel@3:14 export:Panel@4:10', "call:load@3:31 export:Panel@4:10"),
    "jsx": ('import { h } from "x";\nexport function Panel(p) { return <Box n={p.n} />; }\nexport const usePanel = () => load();\nexport { Panel };\n', 'import:"x"@1:19 function:Panel@2:17 function:usePanel@3:14 export:Panel@4:10', "call:load@3:31 export:Panel@4:10"),
    "java": (
        '''package a.b;
import java.util.List;
import static java.lang.Math.*;
/** class CommentFake {} */
@Deprecated
public class Boat<T extends Hull> implements Crane {
    private static final Map<String, List<T>> LOADS = new HashMap<>();
    int width, height = 2;
    public Boat(int width) { this.width = width; }
    @Override
    public <U> List<U> lift(final T load, int... more) throws Bad {
        String s = "void stringFake() {}";
        if (load != null) { check(load); }
        return load.items();
    }
    interface Crane { void lift(); }
    enum Size { SMALL(1), LARGE(2); final int n; Size(int n) { this.n = n; } int twice() { return n * 2; } }
    record Pair(int a, int b) { }
}
''',
        "import:java.util.List@2:8 import:java.lang.Math@3:15 class:Boat@6:14 variable:LOADS@7:47 variable:width@8:9 variable:height@8:16 method:Boat@9:12 method:lift@11:24 interface:Crane@16:15 method:lift@16:28 enum:Size@17:10 variable:n@17:47 method:Size@17:50 method:twice@17:82 type:Pair@18:12",
        "call:check@13:29 call:items@14:21",
    ),
    "go": (
        '''package harbour

import (
	"fmt"
	str "strings"
)

const (
	Limit = 3
	Depth, Width = 1, 2
)
var Registry = map[string]int{}

type Crane struct {
	Name string // func CommentFake()
}
type (
	Lifter interface {
		Lift(x int) error
	}
	ID = string
	Load int
)

func New(name string) *Crane { return &Crane{Name: fmt.Sprint(name)} }
func (c *Crane) Lift(x int) error {
	_ = `func RawFake() {}`
	return check(x)
}
''',
        'module:harbour@1:9 import:"fmt"@4:2 import:"strings"@5:6 constant:Limit@9:2 constant:Depth@10:2 constant:Width@10:9 variable:Registry@12:5 struct:Crane@14:6 interface:Lifter@18:2 type:Load@22:2 function:New@25:6 method:Lift@26:17',
        "call:Sprint@25:56 call:check@28:9",
    ),
    "c": (
        '''#include <stdio.h>
#include "crane.h"
#define FAKE(x) int macro_fake(int x) { }
/* int comment_fake(void) {} */
struct crane { int width; };
union load { int a; float b; };
enum size { SMALL, LARGE };
typedef struct crane crane_t;
static int counter = 0;
int lift(int x);
int build(const char *name) {
    int total = 1;
    printf("int string_fake(void) {}");
    return lift(total);
}
''',
        'import:<stdio.h>@1:10 import:"crane.h"@2:10 struct:crane@5:8 type:load@6:7 enum:size@7:6 type:crane_t@8:22 variable:counter@9:12 function:lift@10:5 function:build@11:5 variable:total@12:9',
        "call:printf@13:5 call:lift@14:12",
    ),
    "cpp": (
        '''#include <vector>
namespace harbour {
class Crane : public Hull {
public:
    explicit Crane(int w) : width(w) {}
    int lift(int x) const;
    virtual ~Crane() = default;
private:
    int width;
};
struct Load { int weight; };
enum class Size { Small, Large };
template <typename T> T twice(T x) { return x + x; }
int Crane::lift(int x) const { return twice(x); }
}
static int counter = 3;
int build() { harbour::Crane c(2); return c.lift(R"(int raw_fake() {})"[0]); }
''',
        "import:<vector>@1:10 module:harbour@2:11 class:Crane@3:7 method:Crane@5:14 method:lift@6:9 struct:Load@11:8 enum:Size@12:12 function:twice@13:25 method:lift@14:12 variable:counter@16:12 function:build@17:5",
        "call:twice@14:39 call:lift@17:45",
    ),
    "cs": (
        '''using System.Text;
using static System.Math;
#region class RegionFake {}
namespace Harbour.Tools
{
    public interface ILift { int Lift(int x); }
    public record Pair(int A, int B);
    public struct Point { public int X; }
    public enum Size { Small, Large }
    [Serializable]
    public class Crane<T> : Hull, ILift where T : new()
    {
        private readonly Dictionary<string, List<T>> loads = new();
        public string Name { get; set; } = "void StringFake() {}";
        public int Width => 3;
        public Crane(int width) : base(width) { }
        public int Lift(int x) { return x; }
        public static T Make<U>(U u) => new T();
    }
}
''',
        "import:System.Text@1:7 import:System.Math@2:14 module:Harbour.Tools@4:11 interface:ILift@6:22 method:Lift@6:34 type:Pair@7:19 struct:Point@8:19 variable:X@8:38 enum:Size@9:17 class:Crane@11:18 variable:loads@13:54 variable:Name@14:23 variable:Width@15:20 method:Crane@16:16 method:Lift@17:20 method:Make@18:25",
        "",
    ),
    "sh": ('#!/bin/bash\n# fake_comment() { :; }\nROOT="/srv"\nexport NAME=x\nbuild_it() {\n  local part=1\n  echo "fake_string() { :; }" == x\n}\nfunction lift { :; }\n', "variable:ROOT@3:1 variable:NAME@4:8 function:build_it@5:1 variable:part@6:9 function:lift@9:10", ""),
    "rb": ('# class CommentFake\nmodule Harbour\n  LIMIT = 3\n  class Crane < Hull::Base\n    def initialize(w)\n      @w = "def string_fake"\n    end\n    def self.build(x) = new(x)\n    def tall?; @w == 3; end\n  end\n  class Deep::Part; end\nend\n', "module:Harbour@2:8 constant:LIMIT@3:3 class:Crane@4:9 method:initialize@5:9 method:build@8:14 method:tall?@9:9 class:Part@11:15", ""),
    "php": (
        '''<html>
<?php
namespace Harbour\\Tools;
require_once "base.php";
const LIMIT = 3;
// class CommentFake {}
interface Lift { public function lift(int $x): int; }
trait Builds { protected function build(): string { return "class StringFake {}"; } }
abstract class Crane extends Hull implements Lift {
    private ?string $name = null;
    public static int $count = 0;
    public function lift(int $x): int { return $x; }
}
enum Size { case Small; }
function helper() { return new class { }; }
''',
        'module:Harbour\\Tools@3:11 import:"base.php"@4:14 constant:LIMIT@5:7 interface:Lift@7:11 method:lift@7:34 trait:Builds@8:7 method:build@8:35 class:Crane@9:16 variable:name@10:22 variable:count@11:24 method:lift@12:21 enum:Size@14:6 function:helper@15:10',
        "",
    ),
    "scala": ('package harbour.tools\nimport scala.math\n// class CommentFake\ntrait Lift { def lift(x: Int): Int }\ncase class Crane(width: Int) extends Lift {\n  val name: String = "class StringFake"\n  var count = 0\n  def lift(x: Int): Int = x\n}\nobject Crane { type Id = Long }\nenum Size { case Small, Large }\n', "module:harbour.tools@1:9 import:scala@2:8 trait:Lift@4:7 function:lift@4:18 class:Crane@5:12 constant:name@6:7 variable:count@7:7 function:lift@8:7 module:Crane@10:8 type:Id@10:21 enum:Size@11:6", ""),
    "kt": ('package harbour.tools\nimport kotlin.math.abs\n// class CommentFake\nclass Crane(val width: Int) {\n  val name = "fun stringFake() {}"\n  fun lift(x: Int): Int = abs(x)\n}\nenum class Size { SMALL, LARGE; fun twice() = 2 }\nobject Registry { var count = 0 }\ntypealias Id = Long\nfun String.build(): Crane = Crane(3)\n', "module:harbour.tools@1:9 import:kotlin.math.abs@2:8 class:Crane@4:7 variable:name@5:7 function:lift@6:7 class:Size@8:12 enum:SMALL@8:19 enum:LARGE@8:26 function:twice@8:37 module:Registry@9:8 variable:count@9:23 type:Id@10:11 function:build@11:12", ""),
    "swift": ('import Foundation\n// class CommentFake {}\nlet limit = 3\nprotocol Lift { func lift() -> Int }\nstruct Load { var weight: Int }\nenum Size { case small }\ntypealias Id = Int\nfinal class Crane: Lift {\n  private let name = "func stringFake() {}"\n  init(x: Int) { let inner = x; _ = inner }\n  func lift() -> Int { return 1 }\n}\nfunc build() -> Crane { return Crane(x: 1) }\n', "import:Foundation@1:8 variable:limit@3:5 interface:Lift@4:10 struct:Load@5:8 variable:weight@5:19 enum:Size@6:6 type:Id@7:11 class:Crane@8:13 variable:name@9:15 method:lift@11:8 function:build@13:6", ""),
    "dart": ("import 'dart:io';\nexport 'src/x.dart';\n// class CommentFake {}\nconst limit = 3;\nvar count = 0;\ntypedef Id = int;\nenum Size { small, large }\nmixin Lift { void lift() {} }\nclass Crane extends Hull {\n  final int width;\n  Crane(this.width);\n  Crane.small() : width = 1;\n  int get twice => width * 2;\n  String name(int x) { return 'class StringFake {}'; }\n}\nextension Twice on int { int doubled() => this * 2; }\nCrane build(int x) => Crane(x);\n", "import:'dart:io'@1:8 export:'src/x.dart'@2:8 constant:limit@4:7 variable:count@5:5 type:Id@6:9 enum:Size@7:6 constant:small@7:13 constant:large@7:20 class:Lift@8:7 method:lift@8:19 class:Crane@9:7 method:Crane@11:3 method:Crane@12:3 method:twice@13:11 method:name@14:10 type:Twice@16:11 method:doubled@16:30 function:build@17:7", ""),
    "nix": ("# fake = x: x;\nlet\n  tools = import ./tools.nix;\n  make = { name, size ? 3 }: name;\n  twice = x: x * 2;\n  note = \"fake = y: y;\";\nin {\n  part = { width = 3; };\n}\n", "import:tools@3:3 function:make@4:3 function:twice@5:3 module:part@8:3", ""),
    "py": (
        '''"""def docstring_fake(): pass"""
import os
import json as j
from a.b import c
from . import d
# class CommentFake: pass
LIMIT: int = 3
class Crane:
    name = "class StringFake: pass"
    def lift(self, x):
        y = z = check(x)
        return self.load(y)
async def build():
    return Crane()
''',
        "import:os@2:8 import:a.b@4:6 variable:LIMIT@7:1 class:Crane@8:7 variable:name@9:5 function:lift@10:9 variable:y@11:9 variable:z@11:13 function:build@13:11",
        "call:check@11:17 call:load@12:21 call:Crane@14:12",
    ),
}
