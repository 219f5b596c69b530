"""Which comment rules an extension gets."""

from __future__ import annotations

#: Comment style of each extension, in lower case. Others have no comments.
STYLES: dict[str, str] = {
    ext: style
    for style, exts in {
        "c": "c c++ cc cpp cs css cxx dart go gradle groovy h h++ hh hpp hxx java json jsonc ld lds less m mm proto sass scss sol sv svh thrift v zig",
        "c_nested": "kt kts rs sc scala",
        "javascript": "cjs cts js jsx mjs mts ts tsx",
        "swift": "swift",
        "d": "d",
        "php": "php",
        "python": "py pyi pyw",
        "ruby": "cr gemspec rake rb",
        "perl": "perl pl pm",
        "shell": "bash sh zsh",
        "hash": "awk cfg cmake coffee conf dockerfile ex exs fish gql graphql ini makefile mk nim nix properties r rmd sed tcl tf tfvars toml yaml yml",
        "powershell": "ps1 psd1 psm1",
        "lua": "lua",
        "html": "htm html svg vue xhtml xml xsd xsl xslt",
        "sql": "sql",
        "haskell": "elm hs lhs purs",
        "julia": "jl",
        "ocaml": "dpk dpr fs fsi fsscript fsx fun ml mli pas pp sig sml",
        "lisp": "cl clj cljc cljs edn el lisp lsp rkt scm ss",
        "erlang": "bib erl hrl ltx sty tex",
        "fortran": "f f03 f08 f90 f95 for ftn",
        "matlab": "mat mlx oct",
        "batch": "bat cmd",
        "assembly": "asm inc masm nasm",
        "gas": "s",
        "vhdl": "vhd vhdl",
        "basic": "bas cls frm vb vbs",
    }.items()
    for ext in exts.split()
}
NO_COMMENTS = "none"

#: String literals beyond "..." and '...' by extension; a C-style extension that isn't here has just those two.
LITERALS: dict[str, str] = {
    ext: kind
    for kind, exts in {
        "rust": "rs",
        "cpp": "c++ cc cpp cxx h++ hh hpp hxx",
        "csharp": "cs",
        "text_block": "dart gradle groovy java kt kts sc scala",
        "backtick": "go",
        "double_only": "sv svh v",
    }.items()
    for ext in exts.split()
}

#: Styles whose every line stands for itself; Spark counts them without Python.
STATELESS = ("vhdl", "erlang", "lisp", "assembly", "batch", "basic", "fortran", NO_COMMENTS)
#: Styles that leave every CR and LF out of the characters, not just a line's own end.
NO_BREAKS = ("c", "c_nested")


def style_of(ext: str) -> str:
    """The comment style of an extension in any case."""
    return STYLES.get(ext.lower(), NO_COMMENTS)


def literals_of(ext: str) -> str:
    return LITERALS.get(ext.lower(), "plain")


def effective(ext: str, mapping: dict[str, str] | None) -> str:
    """What an extension, in the case it has, is mapped to."""
    return (mapping or {}).get(ext, ext)
