"""The statement language: lexer, parser, strict type checks and compilation to DataFrames."""
