"""Line machines: what each style takes for code."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.functions.analyzers import Machine, count_code, machine_for, register, split_lines
from textloom.functions.literals import Quoting, find_hash_python, find_outside, find_outside_sql, find_outside_swift, find_unquoted, inside_quotes
from textloom.functions.styles import LITERALS, STYLES, style_of

CASES = [
    ("py", ["def foo():", '"""', "Docstring", '"""', "return 1"], [1, 0, 0, 0, 1]),
    ("py", ['v = f"""', "text { # note", "1 }", '"""'], [1, 1, 1, 1]),
    ("py", ["bar# it's\n", "still inside\n", "'\n", "# now a comment\n"], [1, 1, 1, 0]),
    ("py", ["#!/usr/bin/env python", "#!again", "x = 1  # y", ""], [0, 0, 1, 0]),
    ("py", ["s = '''a", "", "b'''"], [1, 1, 1]),
    ("py", ['x = ""  # c', "# c"], [1, 0]),
    ("py", [r's = r"\" # still"', "# c"], [1, 0]),
    ("rs", ["/* a /* b /* c */ d */ e */"], [0]),
    ("rs", ['let x = r#"a // " b"#; // c', "fn f<'a>(x: &'a str) {} // '", r"let c = '\u{10FFFF}'; // d", "// e"], [1, 1, 1, 0]),
    ("rs", ['let s = "a', "// inside", 'end"; // c', "// out"], [1, 1, 1, 0]),
    ("c", ["/* a", "b", "c */ int x;", 'puts("/*"); // d', "", "   ", "/* a */ /* b */"], [0, 0, 1, 1, 0, 0, 0]),
    ("cpp", ['auto s = R"x(a)" // )x"; // c', 'R"y(', '// a"', '// b'], [1, 1, 1, 0]),
    ("cs", ['var s = @"a\\";', "// c", 'var t = @"x ""', "// in\" + 1;", "// d"], [1, 0, 1, 1, 0]),
    ("java", ['String s = """\n', "// hi\n", '""";\n'], [1, 1, 1]),
    ("java", ['String s = """ // a """; // c'], [1]),
    ("go", ["s := `a", "// in", "`", "// out"], [1, 1, 1, 0]),
    ("v", ["a = 'b1; // c", "// d'"], [1, 0]),
    ("js", ["let a = `x ${ b // c", "+ 1 } y`", "/re[/]g/.test(x) // c", "a / b // c", "/* x", " */ y", ""], [1, 1, 1, 1, 0, 1, 0]),
    ("ts", ["#!/usr/bin/env node", "s = 'a", "", "'", "// c"], [0, 1, 1, 1, 0]),
    ("swift", ['let s = #"a // b"# // c', "/* x /* y */", "z */ code", '"""a // """ // d', "// e", "", "x /* y */ z"], [1, 0, 0, 1, 0, 1, 1]),
    ("rb", ["foo(<<A, <<B)", "a", "A", "b", "B"], [1, 1, 1, 1, 1]),
    ("rb", ["x = <<-E", "", "# data", "  E", "# c", "=begin", "z", "=end", 's = "#{a + "#"}" # c', "# d"], [1, 0, 1, 1, 0, 0, 0, 0, 1, 0]),
    ("pl", ["#!/usr/bin/perl", "=head1 A", "x", "=cut", "print <<E;", "# data", "E", "# c", "$x = '#'; # d", ""], [0, 0, 0, 0, 1, 1, 1, 0, 1, 0]),
    ("pl", ["1 << 3;\n", "# data\n", "3\n", "# c\n"], [1, 1, 1, 0]),
    ("php", ["$x = 'http://a';", "/* a", "b */ # c", "d */ e", "echo <<<EOT", "# in", "  EOT;", "# x"], [1, 0, 0, 1, 1, 1, 1, 0]),
    ("sh", ["cat <<EOF\n", "# in\n", "EOF\n", "# out\n"], [1, 1, 1, 0]),
    ("sh", ["cat <<-EOF\n", "EOF\n", "# never ends\n"], [1, 1, 1]),
    ("sh", ["cat <<'E' > x\n", "\n", "E\n", "# c\n", 'echo "<<F"\n', "# d\n"], [1, 0, 1, 0, 1, 0]),
    ("toml", ["#!x", "a = '#' # b", "# c", "", "a = 1 # d"], [0, 1, 0, 1, 1]),
    ("ps1", ["<# a", "b #> x # y", "c #>", '"#" # c', "# d", "", "x <# a #> y"], [0, 1, 1, 1, 0, 0, 1]),
    ("lua", ["--[==[", "x ]]", "]==] y", "--[[ a ]] x", " -- y", "", "-- z"], [0, 0, 0, 0, 1, 1, 0]),
    ("html", ["<!-- a", "b --> c", "x <!-- y --> z <!-- w", "", "<!-- a -->"], [0, 1, 1, 1, 0]),
    ("sql", ["select '--' -- c", "/* a */ x /* b", "c */ -- d", "*/", "-- e", "", "x /* y", "z */ w"], [1, 1, 0, 1, 0, 1, 1, 1]),
    ("hs", ["-- a", " -- b", "{- x -} y", "{- a", "{- b -}", "-} z", "w"], [0, 1, 1, 0, 0, 0, 1]),
    ("jl", ["#= a =# x", "# c", "x #= y", "=# z", "w"], [1, 0, 1, 0, 1]),
    ("ml", ["(* a (* b *) c *)", "(* x", "*) y", "let z = 1", ""], [0, 0, 0, 1, 1]),
    ("d", ["/+ a", "/+ b +/", "+/ x /* y", "z */ code", "a // b", 'r"x//y"', "/* a */ b /* c"], [0, 0, 0, 1, 1, 1, 1]),
    ("mlx", ["%{", "a", "%}", "x % y", "% z", ""], [0, 0, 0, 1, 0, 1]),
    ("s", ["/* a */ x", "# c", "@ d", "/* b", "c */ y", "mov"], [1, 0, 0, 0, 1, 1]),
    ("f90", ["C a", "call x", "  call y", "! b", "  ! c", "", "* d", "x = 1 ! e"], [0, 0, 1, 0, 0, 0, 0, 1]),
    ("vhd", ["-- a", "  -- b", "x -- c", ""], [0, 0, 1, 1]),
    ("bat", ["REM a", "rem\tb", ":: c", "@rem d", "REM\n", "echo REM", ""], [0, 0, 0, 0, 1, 1, 1]),
    ("vb", ["' a", "Rem b", "x ' c", ""], [0, 0, 1, 1]),
    ("tex", ["% a", "b % c", ""], [0, 1, 1]),
    ("el", ["; a", " ;; b", "(c) ; d", ""], [0, 0, 1, 1]),
    ("asm", ["; a", "mov ; b"], [0, 1]),
    ("txt", ["// a", "", " 　\t", "\x1c"], [1, 0, 0, 1]),
]


@pytest.mark.parametrize(("ext", "lines", "wanted"), CASES)
def test_lines(ext, lines, wanted):
    machine = machine_for(ext)
    assert [int(machine.code(x)) for x in lines] == wanted


@pytest.mark.parametrize(("ext", "lines", "wanted"), CASES)
def test_state_is_taken_up_again(ext, lines, wanted):
    machine = machine_for(ext)
    out = []
    for line in lines:
        fresh = machine_for(ext)
        fresh.restore(machine.state())
        out.append(int(fresh.code(line)))
        machine = fresh
    assert out == wanted
    machine.reset()
    assert machine.state() == machine_for(ext).state()


def test_in_comment():
    machine = machine_for("c")
    machine.code("int a; /* b")
    assert machine.in_comment
    machine.code("*/")
    assert not machine.in_comment


def test_styles():
    assert len(STYLES) == 161
    assert style_of("M") == "c" and style_of("mat") == "matlab" and style_of("cr") == "ruby" and style_of("nope") == "none"
    assert set(LITERALS) <= {e for e, s in STYLES.items() if s.startswith("c")}


def test_mapping_reads_the_extension_as_written():
    assert count_code("# a\n", "H", {"H": "PY"}) == 0
    assert count_code("# a\n", "h", {"H": "PY"}) == 1


def test_register():
    class Nothing(Machine):
        def code(self, line):
            return False

    register("zzz", Nothing)
    assert count_code("a\nb\n", "zzz") == 0


@pytest.mark.parametrize(("text", "lines"), [("", []), ("a", ["a"]), ("a\n", ["a\n"]), ("a\n\n", ["a\n", "\n"]), ("a\rb\r\nc", ["a\rb\r\n", "c"])])
def test_split_lines(text, lines):
    assert split_lines(text) == lines


def test_searches():
    assert find_outside("'//' // x", "//") == 5
    assert find_outside("'a long text // x' // y", "//") == 13  # a quote without an end nearby is a lifetime
    assert find_outside('br#"//"# //', "//") == 9
    assert find_outside("xr\"//\" //", "//") == 7
    assert find_outside_swift('##"a"# // "## //', "//") == 14
    assert find_outside_sql("'it''s --' \"a\"\"--\" --", "--") == 19
    assert find_hash_python("rb'#' f\"\"\"#\"\"\" #") == 15
    assert find_unquoted("'#' \\# \"#\" #", "#") == 11
    assert inside_quotes("a '<<", 3) and not inside_quotes("'a' <<", 4) and not inside_quotes("\\' <<", 3)


def test_quoting_from_left_to_right():
    """Asking for places in turn gives what asking for each alone gives."""
    import random

    rng = random.Random(3)
    for _ in range(300):
        line = "".join(rng.choice("ab\\\"'<") for _ in range(rng.randrange(1, 25)))
        quoting = Quoting(line)
        assert [quoting.inside(k) for k in range(len(line) + 1)] == [inside_quotes(line, k) for k in range(len(line) + 1)], line


@pytest.mark.parametrize("ext", ["pl", "sh", "php", "rb"])
@pytest.mark.parametrize("pattern", ["<<A ", "<<", "<<'", "\"<<A\\", "a'<<<A "])
def test_long_lines_of_here_documents(ext, pattern):
    import time

    began = time.process_time()
    count_code(pattern * (200_000 // len(pattern)) + "\nA\n", ext)
    assert time.process_time() - began < 10


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t\r'\"`#/*<>-={}()[]\\$%;!@+~é　", max_size=80), st.sampled_from(sorted(STYLES)))
def test_no_text_breaks_a_machine(text, ext):
    lines = split_lines(text)
    assert "".join(lines) == text
    assert 0 <= count_code(text, ext) <= len(lines)


def test_many_blocks_on_a_line():
    assert count_code("(* *)" * 5000 + " x", "ml") == 1
    assert count_code("/* */" * 5000 + " x", "sql") == 1


ALPHABET = ["\n", "\n", "\n", " ", "  ", "a", "b1", "f", "r", "x = 1", "#", "#!", "//", "/*", "*/", "/", '"', "'", "`", '"""', "<!--", "-->", "--", "--[[", "]]", "{-", "-}", "#=", "=#", "(*", "*)", "/+", "+/", "%", "%{", "%}", "<<", "<<A", "<<-'A'", "<<<A", "A", "A;", "=pod", "=cut", "=begin", "=end", "<#", "#>", "@", "{", "}", "${", "#{", "\\", "R\"(", ")\"", "r#\"", "\u2003", "\x1c", "\r\n"]


@pytest.mark.parametrize("ext", sorted({e for e in STYLES if e in {"c", "cpp", "cs", "java", "go", "rs", "kt", "js", "swift", "d", "php", "py", "rb", "pl", "sh", "toml", "ps1", "lua", "html", "sql", "hs", "jl", "ml", "mlx", "s", "f90", "vhd"}}))
@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=30))
def test_counting_a_text_is_counting_its_lines(ext, parts):
    text = "".join(parts)
    whole, lines = machine_for(ext), machine_for(ext)
    assert whole.count(text) == sum(map(lines.code, split_lines(text)))
    # some styles never ask which line is the first
    assert whole.state() | {"lines": 0} == lines.state() | {"lines": 0}
