"""The pipeline language: lexer, syntax tree, parser and formatter."""
