import pytest
from helpers import BECKY, DAISY, JOHN, JULIO, document, engine, sentence, spans
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.errors import QueryError
from loomspan.functions.text import aggressive
from loomspan.operators import match as M
from loomspan.plans.pattern import parse_basic, parse_event


def found(pattern, text, select=True):
    toks = text.split()
    s = M.Sentence(len(toks), {"raw": toks, "word": toks, "norm": [[aggressive(t)] for t in toks]})
    got = M.surface(parse_basic(pattern), s)
    return [(m[0], m[1]) for m in (M.select(got) if select else got)]


CASES = [
    ("a b* c", "a c", [(0, 2)]), ("a b? c", "a b c", [(0, 3)]), ("a []* c", "a b c a b c", [(0, 6)]), ("a []*? c", "a b c a b c", [(0, 3), (3, 6)]),
    ("(a+ | b)*", "a b", [(0, 2), (2, 2)]), ("(a+ | b)*?", "a b", [(0, 0), (1, 1), (2, 2)]), ("(a+ | b)?", "a b", [(0, 1), (1, 2), (2, 2)]),
    ("a (x | x x)", "a x x", [(0, 2)]), ("a (x x | x)", "a x x", [(0, 3)]), ("[] (?!a)", "a b a c", [(0, 1), (2, 3), (3, 4)]),
    ("(?<=a) []", "a b a c", [(1, 2), (3, 4)]), ("(?<!a) []", "a b a c", [(0, 1), (2, 3)]), ("[!raw=b]", "a b a c", [(0, 1), (2, 3), (3, 4)]),
    ("<s> []", "a b", [(0, 1)]), ("[] </s>", "a b", [(1, 2)]), ("a{2,3}", "a a a a", [(0, 3)]), ("a{2,3}?", "a a a a", [(0, 2), (2, 4)]), ("a{2}", "a a a", [(0, 2)]),
    ("([] []){2,}", "a b c d", [(0, 4)]), ("a{,2}", "a", [(0, 1), (1, 1)]), ("/[ab]/ c # note", "b c", [(0, 2)]), ("fooo~", "foo ofo far", [(0, 1), (1, 2)]), ("(?=a b) []", "a b a", [(0, 1)]),
    ("[raw=a | raw=b]", "a b c", [(0, 1), (1, 2)]), ("[!(raw=a | raw=b)]", "a b c", [(2, 3)]), ("[!!raw=a]" if False else "[raw!=a]", "a b", [(1, 2)]),
]


@pytest.mark.parametrize("pattern,text,want", CASES)
def test_surface(pattern, text, want):
    assert found(pattern, text) == want


@pytest.mark.parametrize("bad", ["a {3,2}", "[nofield=x]", "a )", "(a", "", "/(/", "@", "trigger = a"])
def test_bad_patterns(bad):
    with pytest.raises(QueryError):
        parse_basic(bad)


def test_repeated_argument_names():
    with pytest.raises(QueryError):
        parse_event("trigger = a  x = >b  x = >c")


PAIRS = [("Café", "cafe"), ("é", "é"), ("½", "1/2"), ("µ", "μ"), ("Μ", "μ"), ("straße", "strasse"), ("“x”", '"x"'), ("’", "'"), ("•", "-"), ("Œuf", "oeuf"), ("x™", "x(TM)"), ("ç", "c")]


@pytest.mark.parametrize("a,b", PAIRS)
def test_normal_form(a, b):
    assert aggressive(a) == aggressive(b)


def naive(x, toks, i):
    """Ends of matches of a pattern without preferences that begin at i."""
    kind = x[0]
    if kind == "tok":
        p = x[1]
        ok = i < len(toks) and (p[0] == "any" or p[2] == toks[i])
        return {i + 1} if ok else set()
    if kind == "seq":
        ends = {i}
        for y in x[1]:
            ends = {e for j in ends for e in naive(y, toks, j)}
        return ends
    if kind == "alt":
        return set().union(*(naive(y, toks, i) for y in x[1]))
    _, y, least, most, _ = x
    out, now, k = set(), {i}, 0
    while now and (most is None or k <= most) and k <= len(toks) + least + 1:
        if k >= least:
            out |= now
        now = {e for j in now for e in naive(y, toks, j)}
        k += 1
    return out


TOK = st.sampled_from(["a", "b", "[]"])
PATTERN = st.recursive(TOK, lambda p: st.one_of(st.tuples(p, p).map(lambda t: f"({t[0]} {t[1]})"), st.tuples(p, p).map(lambda t: f"({t[0]} | {t[1]})"), st.tuples(p, st.sampled_from(["?", "*", "+", "{2}", "{1,2}", "+?", "*?"])).map(lambda t: f"({t[0]}){t[1]}")), max_leaves=5)


@settings(max_examples=250, deadline=None)
@given(PATTERN, st.lists(st.sampled_from("ab"), max_size=6))
def test_all_spans_equal_naive(pattern, toks):
    tree = parse_basic(pattern)
    want = {(i, e) for i in range(len(toks) + 1) for e in naive(tree, toks, i)}
    assert set(found(pattern, " ".join(toks), select=False)) == want


@settings(max_examples=250, deadline=None)
@given(PATTERN, st.lists(st.sampled_from("ab"), max_size=6))
def test_selected_spans_dont_overlap(pattern, toks):
    got = found(pattern, " ".join(toks))
    assert got == sorted(got)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert c >= b or a == c


def test_fields(spark):
    e = engine(spark, document("d", BECKY))
    assert spans(e.query("ATE")) == spans(e.query("[norm=ATE]")) == spans(e.query("[raw=ate]")) == [(1, 2)]
    assert spans(e.query("[raw=ATE]")) == []
    assert spans(e.query("[tag=/N.*/ & !entity=PERSON]")) == [(3, 4)]
    assert spans(e.query("[outgoing=dobj]")) == [(1, 2)] and spans(e.query("[incoming=/n.*/]")) == [(0, 1)]
    with pytest.raises(QueryError):
        e.query("[nope=x]")
    with pytest.raises(QueryError):
        e.with_text(e.query("ate"), "nope")
    r = e.with_text(e.query("(?<x> gummy) bears")).first()
    assert (r.text, r.cap_texts) == ("gummy bears", ["gummy"])


def test_native_equals_general(spark):
    e = engine(spark, document("d", BECKY, JOHN, JULIO), document("e", sentence("a a a b a a"), sentence("")))
    for p in ["a a", "[] []", "a", "[tag=/N.*/] []", "a{3}", "[raw!=a] a"]:
        tree = e.compile(p)
        plain = sorted((r.doc_id, r.sent_id, r.start, r.end) for r in e.query(p).collect())
        general = sorted((r.doc_id, r.sent_id, r.start, r.end) for r in e.query(("cap", "x", None, tree)).collect())
        assert plain == general, p
        assert len(e.query(p, all_matches=True).collect()) >= len(plain)


def test_traversals(spark):
    e = engine(spark, document("j", JULIO), document("k", JOHN))
    assert spans(e.query("She saw >dobj [] (>conj_and [])?")) == [(2, 3), (4, 5)]
    assert spans(e.query("me >conj_and []")) == [(4, 5)]
    assert spans(e.query("Julio <conj_and []")) == [(2, 3)]
    assert spans(e.query("She <nsubj >dobj []")) == [(2, 3), (4, 5)]
    assert spans(e.query("saw >/n.*/ []")) == [(0, 1)]
    assert spans(e.query("saw >> []")) == [(0, 1), (2, 3), (4, 5), (5, 6)]
    assert spans(e.query("me << []")) == [(1, 2)]
    assert spans(e.query("She <nsubj? []")) == [(0, 1), (1, 2)]
    assert spans(e.query("saw >>{2} []")) == [(3, 4), (4, 5)]
    assert spans(e.query("saw >>+ [tag=NNP]")) == [(4, 5)]
    assert spans(e.query("saw >nothere []")) == []
    assert spans(e.query("John <nsubj >nmod_with (?^ [] >conj [])")) == [(4, 8)]
    loop = engine(spark, document("l", sentence("a b c", [(0, 1, "x"), (1, 2, "x"), (2, 0, "x")])))
    assert spans(loop.query("a (>x [])*")) == [(0, 1), (1, 2), (2, 3)]
    assert spans(loop.query("a >x* []")) == [(0, 1), (1, 2), (2, 3)]


def event(e, rule, **k):
    return sorted((r.start, r.end, tuple((c.name, c.s, c.e) for c in r.caps if c.parent < 0)) for r in e.extract([*e.rules(f"rules:\n  - name: r\n    type: event\n    label: E\n    pattern: |\n{rule}")], **k).collect() if r.kind == "event")


def rule(text):
    return "".join(f"      {x.strip()}\n" for x in text.split(";"))


def test_events(spark):
    e = engine(spark, document("b", BECKY))
    assert event(e, rule("trigger = ate; object: ^NP = >dobj gummy? bears")) == [(1, 2, (("object", 2, 4),))]
    assert event(e, rule("trigger = ate; object: ^NP = >dobj")) == [(1, 2, (("object", 3, 4),))]
    assert event(e, rule("trigger = ate; object: NP = >dobj")) == []
    assert event(e, rule("trigger = ate; object = >dobj []; who = >nsubj []")) == [(1, 2, (("object", 3, 4), ("who", 0, 1)))]
    state = e.query("[chunk=B-NP] [chunk=I-NP]*", label="NP")
    assert event(e, rule("trigger = ate; subject: NP = >nsubj; object: NP = >dobj"), state=state) == [(1, 2, (("subject", 0, 1), ("object", 2, 4)))]
    assert event(e, rule("trigger = ate; none = >iobj []; object = >dobj []")) == []
    assert event(e, rule("trigger = ate; none? = >iobj []; object = >dobj []")) == [(1, 2, (("object", 3, 4),))]


def test_quantified_arguments(spark):
    e = engine(spark, document("m", JOHN, DAISY))
    one = rule("trigger = [lemma=eat]; theme = >dobj []; tool = >nmod_with []")
    assert event(e, one) == [(1, 2, (("theme", 2, 3), ("tool", 4, 5))), (1, 2, (("theme", 2, 3), ("tool", 7, 8)))]
    assert event(e, rule("trigger = [lemma=eat]; theme = >dobj []; tool+ = >nmod_with []")) == [(1, 2, (("theme", 2, 3), ("tool", 4, 5), ("tool", 7, 8)))]
    assert event(e, rule("trigger = [lemma=eat]; theme = >dobj []; tool* = >nmod_with []")) == [(1, 2, (("theme", 2, 3),)), (1, 2, (("theme", 2, 3), ("tool", 4, 5), ("tool", 7, 8)))]
    assert event(e, rule("trigger = [lemma=eat]; tool = >nmod_with []; place = >nmod_at []")) == []
    assert len(event(e, rule("trigger = [lemma=eat]; tool? = >nmod_with []"))) == 3
    assert event(e, rule("trigger = [lemma=eat]; tool{2} = >nmod_with []")) == [(1, 2, (("tool", 4, 5), ("tool", 7, 8)))]
    assert event(e, rule("trigger = ate ramen; theme = >dobj []")) == []
    assert len(event(e, rule("trigger = ate ramen; theme = >dobj []"), trigger_overlap=True)) == 1


GRAMMAR = """
vars:
  food: [gummy, ramen]
rules:
  - name: first
    label: First
    type: basic
    priority: 1
    pattern: "[norm=/${food}/] []?"
  - name: second
    label: Second
    type: event
    priority: "2"
    pattern: |
      trigger = ate
      what: First = >dobj
      who: ^Person = >nsubj []
  - name: third
    label: Third
    type: basic
    priority: 1+
    pattern: "(?<inner> @Second)"
"""


def test_cascade(spark):
    e = engine(spark, document("b", BECKY), document("k", JOHN))
    got = e.extract(e.rules(GRAMMAR)).collect()
    labels = sorted((r.doc_id, r.label, r.start, r.end) for r in got)
    assert ("b", "First", 2, 4) in labels and ("b", "Second", 1, 2) in labels and ("b", "Person", 0, 1) in labels
    third = [r for r in got if r.label == "Third" and r.doc_id == "b"][0]
    assert [(c.name, c.parent) for c in third.caps] == [("inner", -1), ("what", 0), ("who", 0)]
    assert {r.label for r in e.extract(e.rules(GRAMMAR), use_state=False).collect()} == {"First"}
    first = e.query("gummy bears", label="First")
    assert [r.label for r in e.query("@First", state=first, label="X").collect()] == ["X"]
    assert spans(e.query("@First \".\"", state=first)) == [(2, 5)]  # a state inside a sequence


def test_limits(spark):
    e = engine(spark, document("b", BECKY, JOHN, JULIO))
    assert {r.sent_id for r in e.query("[]", limit=2).collect()} == {0, 1}
    k = e.sentences.first().doc_key
    assert {r.sent_id for r in e.query("[]", after=(k, 0), limit=1).collect()} == {1}
