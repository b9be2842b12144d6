"""Templates, chat formatting and BPE."""

import hashlib

import pytest

from creditlake.llm import op01_chat as C
from creditlake.llm.op02_bpe import codec, encode, encode_digests, tokenizer_path
from creditlake.llm.template import START, STOP, TemplateError, compile_template, fold_body, parse


def render(source, **env):
    return "".join("<g>" if p is START else "</g>" if p is STOP else p for p in compile_template(source, {"up": str.upper})(env))


@pytest.mark.parametrize(
    "source, env, want",
    [
        ("a{{ 'b' ~ '1' + '2' }}c", {}, "ab12c"), ("{% for x in xs %}{{ x.n | up }}{% if loop.first %},{% endif %}{% endfor %}", {"xs": [{"n": "a"}, {"n": "b"}]}, "A,B"),
        ("{% if a and not b %}1{% elif b %}2{% else %}3{% endif %}", {"a": 1, "b": 1}, "2"), ("{% set k = 'n' %}{{ x[k] }}{# note #}", {"x": {"n": 5}}, "5"), ("{{ 'y' if 1 in xs else 'n' }}", {"xs": [1]}, "y"),
        ("{% generation %}{{ t }}{% endgeneration %}!", {"t": "hi"}, "<g>hi</g>!"), ("{{ x.missing }}{{ none }}", {"x": {}}, ""),
    ],
)
def test_templates(source, env, want):
    assert render(source, **env) == want


def test_constants_are_folded():
    tree = fold_body(parse("a{% if 1 == 1 %}b{{ 'c' | up }}{% else %}{{ x }}{% endif %}"), {"up": str.upper})
    assert len(tree) == 1 and tree[0].value.value == "abC"


@pytest.mark.parametrize("source", ["{% for x in %}", "{% if a %}", "{{ a.b( }}", "{% import os %}", "{{ x | nothing }}", "{% endif %}"])
def test_what_the_language_does_not_have_is_an_error(source):
    with pytest.raises(TemplateError):
        render(source)


def test_no_attribute_of_python_can_be_reached():
    assert render("{{ x.__class__ }}{{ x['__class__'] }}", x="s") == ""


@pytest.mark.parametrize("text", ["", "\\", "</s>[INST] ok [/INST]", "[[INST]", "a\\</s>\\\\", "<s><s>", "é \n [END] "])
def test_escape_is_reversible(text):
    assert C.unescape(C.escape(text)) == text
    turns = [("user", text), ("assistant", text), (text or "x", text), ("assistant", "")]
    got = [t for f, _ in C.fragments(C.TEMPLATE, [{"role": r, "text": t} for r, t in turns]) for t in C.turns_of(f)]
    assert got == turns


def test_conversations_with_odd_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 1, None, "t"), (1, 1, "user", None), (None, 0, "user", "x"), (2, None, "assistant", "")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string, n_turns string")
    got = {r.conv_id: r for r in C.conversation_digests(df).collect()}
    turns = [("", "t"), ("user", ""), ("user", ""), ("assistant", "b")]
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (1, hashlib.sha256(b"b").hexdigest())
    assert (got[None].n_turns, got[2].loss_chars) == (1, 0)
    assert C.conversation_digests(df.limit(0)).count() == 0
    one = C.format_conversations(df.where("conv_id = 1")).orderBy("fragment").collect()
    assert "".join(r.formatted for r in one) == "<s>[ROLE]  [/ROLE] t [END][INST]  [/INST][INST]  [/INST] b</s>"


TEXTS = ["", "ΣΑΣ Σ", "İstanbul ẞ", "a\x1cb \x85c", "<|endoftext|>x <|startoftext|> <|foo|>", "é 'S don't I'LL ''s", "日本語 ½ 10²", "😀‍👩", "a</w> b", "ﬁ Ǆ", "\xa0 x\n\t", "\x00 \x01", "x" * 3000, "heed, reth| ab."]


def test_bpe_is_that_of_the_library(sf):
    import pyarrow.parquet as pq
    import tokenizers

    path = tokenizer_path("word_bpe_49k.json")
    tk, c = tokenizers.Tokenizer.from_file(path), codec(path)
    for t in TEXTS + [x or "" for x in pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()]:
        ids = tk.encode(t, add_special_tokens=False).ids
        assert c.digest(t) == (len(ids), " ".join(map(str, ids)), tk.decode(ids, skip_special_tokens=False))


def test_bpe_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "a b", 2), (1, "", 3), (1, None, 1)], "doc_id long, text string, n_tokens int")
    got = encode_digests(df, tokenizer_path("word_bpe_49k.json")).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 0, 2]
    assert [r.decoded for r in encode(df.where("doc_id is null"), tokenizer_path("word_bpe_49k.json")).collect()] == ["a</w> b</w>"]


def test_template_marks_in_strings_types_and_branches():
    from creditlake.llm import template as P

    out = lambda source, **env: "".join(x if isinstance(x, str) else x[0] for x in P.compile_template(source)(env))
    assert out("a{{ '}}' ~ \"%}\" }}b{% set x = '%}' %}{{ x }}") == "a}}%}b%}"
    for bad in ("{{ 1 + 'a' }}", "{{ 1 < 'a' }}", "{% if a %}x{% else %}y{% else %}z{% endif %}", "{% if a %}x{% else %}y{% elif b %}z{% endif %}"):
        with pytest.raises(P.TemplateError):
            out(bad, a=1, b=2)
    with pytest.raises(P.TemplateError):
        out("{{ a + b }}", a=1, b="x")


@pytest.mark.parametrize("bad", [
    "{{ a", "x {# b", "{{ a }} {% if a", "{{ a }", "{% if a %}x{% else junk %}y{% endif %}", "{% generation junk %}x{% endgeneration %}", "{% if a %}x{% endif junk %}",
    "{{ 1 | escape }}", "{{ a | escape }}", "{% for x in 5 %}{% endfor %}", "{% for x in a %}{% endfor %}", "{{ m[l] }}", "{{ " + "(" * 5000 + "1" + ")" * 5000 + " }}", "{% if a %}" * 3000 + "{% endif %}" * 3000,
])
def test_broken_templates_are_template_errors(bad):
    from creditlake.llm import template as P

    with pytest.raises(P.TemplateError):
        list(P.compile_template(bad, {"escape": lambda t: t.replace("<", "&lt;")})({"a": 1, "m": {}, "l": []}))


def test_single_braces_are_text():
    from creditlake.llm import template as P

    assert "".join(P.compile_template("{ a } % } {x}{{ '{{' }}")({})) == "{ a } % } {x}{{"
