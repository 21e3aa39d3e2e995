import pytest

from echosieve.languages import registry
from echosieve.languages import tokens as k
from echosieve.languages.tokens import ScanError
from echosieve.operators.blocks import normalize


def scan(language, source):
    return [(t.kind, t.text) for t in registry.by_name(language).tokenize(source.encode() if isinstance(source, str) else source)[:-1]]


def blocks(language, source, least=1):
    spec = registry.by_name(language)
    tokens = spec.tokenize(source.encode())
    counted = lambda a, b: sum(t.kind not in spec.strip for t in tokens[a:b])
    return [b.name for b in spec.find_blocks(tokens, counted, least)]


@pytest.mark.parametrize(
    ("language", "source", "expected"),
    [
        ("C++", "", []),
        ("C++", "#define A \\\n 1\nint", [(k.DIRECTIVE, "#define A \\\n 1"), ("int", "int")]),
        ("C++", "a # b ## c", [(k.NAME, "a"), ("#", "#"), (k.NAME, "b"), ("##", "##"), (k.NAME, "c")]),
        ("C++", "a->*b<=>c<<=d", [(k.NAME, "a"), ("->*", "->*"), (k.NAME, "b"), ("<=>", "<=>"), (k.NAME, "c"), ("<<=", "<<="), (k.NAME, "d")]),
        ("C++", "x=1.f+.5e-3+0xFFu+0b1'0+017+1'000.25L", [(k.NAME, "x"), ("=", "="), (k.NUMBER, "1.f"), ("+", "+"), (k.NUMBER, ".5e-3"), ("+", "+"), (k.NUMBER, "0xFFu"), ("+", "+"), (k.NUMBER, "0b1'0"), ("+", "+"), (k.NUMBER, "017"), ("+", "+"), (k.NUMBER, "1'000.25L")]),
        ("C++", "1.x", [(k.NUMBER, "1"), (".", "."), (k.NAME, "x")]),
        ("C++", 'u8R"a(x)")a" L\'c\' U"\\"s"', [(k.STRING, 'u8R"a(x)")a"'), (k.CHAR, "L'c'"), (k.STRING, 'U"\\"s"')]),
        ("C++", "/* a */ b // c", [(k.BLOCK_COMMENT, "/* a */"), (k.NAME, "b"), (k.LINE_COMMENT, "// c")]),
        ("C#", '@"a""b" $"x{d["k"]}{{" """q"r""" @class', [(k.STRING, '@"a""b"'), (k.STRING, '$"x{d["k"]}{{"'), (k.STRING, '"""q"r"""'), (k.NAME, "@class")]),
        ("C#", "a ??= b?.c ?? 1_0m => x", [(k.NAME, "a"), ("??=", "??="), (k.NAME, "b"), ("?.", "?."), (k.NAME, "c"), ("??", "??"), (k.NUMBER, "1_0m"), ("=>", "=>"), (k.NAME, "x")]),
        ("C#", "foreach class", [("cs:foreach", "foreach"), ("class", "class")]),
        ("Python", "def f(): return x ** 2 // 3", [("py:def", "def"), (k.NAME, "f"), ("(", "("), (")", ")"), (":", ":"), ("return", "return"), (k.NAME, "x"), ("**", "**"), (k.NUMBER, "2"), ("//", "//"), (k.NUMBER, "3")]),
        ("Python", "rb'a' f\"\"\"x\ny\"\"\" ! 1j 0o17", [(k.STRING, "rb'a'"), (k.STRING, 'f"""x\ny"""'), (k.INVALID, "!"), (k.NUMBER, "1j"), (k.NUMBER, "0o17")]),
        ("Python", "True is None # c", [("true", "True"), ("py:is", "is"), ("py:None", "None"), (k.LINE_COMMENT, "# c")]),
    ],
)
def test_tokens(language, source, expected):
    assert scan(language, source) == expected


def test_bytes_and_columns():
    tokens = registry.by_name("C++").tokenize("a = \"é\"; b\n  c".encode())
    assert [(t.text, t.line, t.col) for t in tokens] == [("a", 1, 1), ("=", 1, 3), ('"é"', 1, 5), (";", 1, 9), ("b", 1, 11), ("c", 2, 3), ("", 2, 4)]
    assert [t.kind for t in registry.by_name("C++").tokenize("é".encode())] == [k.INVALID, k.INVALID, k.EOF]


@pytest.mark.parametrize(
    ("language", "source", "message"),
    [
        ("C++", 'x "abc', "string"), ("C++", '"a\n"', "string"), ("C++", "/* a", "block comment"), ("C++", "'a\n", "character"), ("C++", 'R"(a', "raw"), ("C++", 'R"' + "d" * 20 + '(a)"', "delimiter"),
        ("C#", '@"a', "verbatim"), ("C#", '$"a', "interpolated"), ("C#", '"""a"', "raw"), ("Python", '"""a', "triple"), ("Python", "'a\n'", "string"),
    ],
)
def test_unterminated(language, source, message):
    with pytest.raises(ScanError, match=message):
        registry.by_name(language).tokenize(source.encode())


@pytest.mark.parametrize(
    ("language", "source", "names"),
    [
        ("C++", "int f(int a) { return a; }", ["f"]),
        ("C++", "int A::g() const noexcept { return 1; }", ["A::g"]),
        ("C++", "auto h() -> T { return {}; }", ["h"]),
        ("C++", "void v() override { if (x) { y(); } }", ["v"]),
        ("C++", "Foo::~Foo() { x(); }", ["Foo"]),
        ("C++", "Foo::Foo(int a) : b_(a), c_(1) { x(); }", ["c_"]),
        ("C++", "Foo::Foo(int a) : data{42}, more{a} { x(); }", ["Foo::Foo"]),
        ("C++", "Foo::Foo(int a) : data(42), more{a} { x(); }", ["Foo::Foo"]),
        ("C++", "template <typename T> int f<T>(T a) { return a; }", ["f"]),
        ("C++", "template <class T> struct S { void g(T a) const { a(); } };", ["g"]),
        ("C++", "auto f() const -> T { return {}; } int x = 1; void g() final { y(); }", ["f", "g"]),
        ("C++", "void f(int a) // note\n { a; } void g(std::function<void()> h = [](int b) { b; }) { h(); }", ["g"]),
        ("C++", "} ) void f() { a; }", ["f"]),
        ("C++", "class A { int x; };", []),
        ("C++", "namespace n { enum E { a, b }; }", []),
        ("C++", "void f() { if (a) { while (b) { c(); } } }", ["f"]),
        ("C++", "void f() { auto g = [](int a) { return a; }; }", ["f"]),
        ("C++", "void f() { (a; ", []),
        ("C#", "class C { int P { get { return 1; } set { x = value; } } }", ["get", "set"]),
        ("C#", "class C { C(int a) : base(a) { x(); } void I.M() { y(); } }", ["C", "I.M"]),
        ("C#", "class C { C() : this(0) { x(); } enum E { A, B } interface I { void N(); } }", ["C"]),
        ("C#", "class C { void P() { items.Select(x => { return x; }); } int Q { init { v = value; } } }", ["P", "init"]),
        ("C#", "namespace N { record R(int A) { int B; } class D(int a) { int e; } }", ["R"]),
        ("C#", "void M<T>(T t) where T : IA<T>, new() { z(); }", ["M"]),
        ("Python", "async def f(a=(1)):\n    return a\n\n@d\ndef g():\n    def inner():\n        pass\n    return inner\n", ["f", "g"]),
        ("Python", "class A:\n    def m(self) -> int: return 1\n", ["m"]),
        ("Python", "def f():\n    x = 1\n# end\n    y = 2\n", ["f"]),
        ("Python", "class A:\n    x = 1\n", []),
    ],
)
def test_block_names(language, source, names):
    assert blocks(language, source) == names


def test_small_blocks_are_looked_into():
    source = "void outer() { void inner() { a = b + c; } }"
    assert blocks("C++", source, 10) == ["outer"]
    assert blocks("C++", "void small() { x; } void large() { a = b + c * d - e; }", 10) == ["large"]


def test_python_body_ends_at_a_comment():
    spec = registry.by_name("Python")
    tokens = spec.tokenize(b"def f():\n    x = 1\n# end\n    y = 2\n")
    found = spec.find_blocks(tokens, lambda a, b: b - a, 1)
    assert [t.text for t in tokens[found[0].start : found[0].end]] == ["x", "=", "1"]


def test_normalized_ids():
    spec = registry.by_name("C++")
    one, two = (spec.tokenize(s) for s in (b"int a = b + 1; // x", b"int c = d + 22;"))
    structural = lambda t: [i for i, _ in normalize(t, spec)]
    textual = lambda t: [i for i, _ in normalize(t, spec, True)]
    assert structural(one) == structural(two)
    assert textual(one) != textual(two)
    assert [i for _, i in normalize(one, spec)] == list(range(7))


def test_char_keyword_and_literal_differ():
    spec = registry.by_name("C++")
    word, literal = (spec.tokenize(s) for s in (b"char c;", b"'a' c;"))
    assert [i for i, _ in normalize(word, spec)] == [k.NUMBER_OF["char"], 1000, k.NUMBER_OF[";"]]
    assert [i for i, _ in normalize(literal, spec)] == [1003, 1000, k.NUMBER_OF[";"]]
    assert normalize(word, spec, True) != normalize(spec.tokenize(b"'char' c;"), spec, True)


def test_registry():
    assert registry.by_extension(".HPP").name == "C++"
    assert registry.by_path("a/b.pyw").name == "Python"
    assert registry.by_path("a/b.xyz") is None
    assert {".cs", ".c", ".hxx"} <= set(registry.code_extensions())


def test_kind_predicates():
    assert k.is_keyword("while") and k.is_keyword("cs:foreach") and k.is_keyword("py:def") and k.is_keyword("char") and not k.is_keyword(k.CHAR)
    assert k.is_csharp("??") and k.is_python(":=") and k.is_comment(k.LINE_COMMENT) and k.is_literal(k.CHAR) and k.is_operator("->*")
    assert not k.is_literal("char") and not set(k.SPECIAL) & k._WORDS
    assert len(k.KINDS) == 228 and len(set(k.KINDS)) == len(k.KINDS) and not set(k.GENERIC.values()) & set(k.NUMBER_OF.values())
