"""Lexer-state maps, bracket summaries and local grammars for source files."""
