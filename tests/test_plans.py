import pytest
from helpers import BECKY, document, engine, sentence, tokens
from hypothesis import given
from hypothesis import strategies as st

from loomspan.errors import QueryError
from loomspan.functions import text as T
from loomspan.plans.pattern import parse_basic
from loomspan.plans.rules import Loader, Priority

D = lambda n, v: {"$type": "x.DateField", "name": n, "date": v}
N = lambda n, v: {"$type": "x.NumberField", "name": n, "value": v}
A = lambda f, l: {"$type": "x.NestedField", "name": "author", "fields": [tokens("first", [f]), tokens("last", l.split())]}


@pytest.fixture(scope="module")
def library(spark):
    docs = [
        [D("pubdate", "2000-05-25"), tokens("doctype", ["article"]), N("citations", 3), A("Agnes", "Moorehead")],
        [D("pubdate", "2005-05-25"), tokens("doctype", ["website"]), A("Agnes", "Mertz"), A("Jane", "Moorehead")],
        [D("pubdate", "2010-05-25"), tokens("doctype", ["article"]), tokens("keywords", ["food", "silly", "outrageous"])],
        [D("pubdate", "2015-05-25"), tokens("doctype", ["Article"]), tokens("keywords", ["food", "games"])],
        [D("pubdate", "2015-05-25"), tokens("doctype", ["website"]), {"$type": "x.StringField", "name": "s", "string": "article"}],
        [D("pubdate", "2020-05-25"), N("citations", 5.5), A("Jose Manuel", "Escárcega")],
    ]
    return engine(spark, *(document("same", sentence("gummy bears are nice ."), metadata=m) for m in docs))


FILTERS = [
    ("pubdate > date(2006, 01, 01)", 4), ("pubdate == date(2015, 'May', 25)", 2), ("pubdate < date(2000)", 0), ("date(2010) <= pubdate", 4), ("citations > 3", 1), ("citations >= 3", 2), ("citations != 5.5", 5), ("5 < citations < 6", 1),
    ("doctype == 'article' || doctype == 'website'", 5), ("doctype == 'article' && citations == 3", 1), ("!(doctype == 'article')", 3), ("doctype != 'article'", 3), ("author{first=='Agnes' && last=='Moorehead'}", 1), ("author{first=='Agnes'}", 2),
    ("author{first contains 'Manuel Jose'}", 0), ("author{first contains 'jose manuel'}", 1), ("author{last=='escarcega'}", 1), ("keywords contains 'food' && keywords contains 'silly'", 1), ("keywords contains 'food' && keywords not contains 'silly'", 1),
    ("2010 < pubdate.year < 2020", 2), ("pubdate.year == 2015", 2), ("author{first=='/A.*/'}", 2), ("keywords contains '/g.mes/'", 1), ("s == 'article'", 0), ("nothing == 'x'", 0), ("!(nothing == 'x')", 6),
]


@pytest.mark.parametrize("f,n", FILTERS)
def test_filters(library, f, n):
    assert library.query("gummy", filter=f).count() == n


@pytest.mark.parametrize("bad", ["doctype", "doctype == 'a' 3", "a == b", "3 < 4", "doctype < 'a'", "foo(3) == x", "pubdate > date(2000, 13)", "a contains 3", "(a == 1", "§"])
def test_bad_filters(library, bad):
    with pytest.raises(QueryError):
        library.query("gummy", filter=bad)


def test_rule_filters(library):
    g = "metadataFilters: \"doctype == 'article'\"\nrules:\n - {name: a, type: basic, label: A, pattern: gummy}\n"
    assert library.extract(g).count() == 3


def test_priorities():
    runs = lambda p: [e for e in range(1, 7) if Priority.parse(p).runs(e)]
    assert (runs("3"), runs("1-3"), runs("4+"), runs("[1,3,5]")) == ([3], [1, 2, 3], [4, 5, 6], [1, 3, 5])
    for bad in ("x", "3-1", "-1", "[]"):
        with pytest.raises(QueryError):
            Priority.parse(bad)


def test_imports(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "main.yml").write_text("vars: {a: outer, w: x}\nrules:\n - import: sub/one.yml\n   vars: {b: site}\n - {name: 'main-${a}', type: basic, pattern: '${w}'}\n")
    (tmp_path / "sub/one.yml").write_text("vars: {a: own, b: own, c: own}\nrules:\n - {name: '${a}-${b}-${c}', type: basic, pattern: y}\n - import: ../two.yml\n")
    (tmp_path / "two.yml").write_text("vars: vars.yml\nrules:\n - {name: 'two-${d}', type: basic, pattern: z, priority: [1, 2]}\n")
    (tmp_path / "vars.yml").write_text("d: file\n")
    path = str(tmp_path / "main.yml")
    assert [r.name for r in Loader().load_file(path)] == ["outer-site-own", "two-file", "main-outer"]
    assert [r.name for r in Loader().load_file(path, {"a": "caller"})] == ["caller-site-own", "two-file", "main-caller"]
    with pytest.raises(QueryError):
        Loader().load("rules: [{import: x.yml}]")
    with pytest.raises(QueryError):
        Loader().load("rules: [{name: '${no}', type: basic, pattern: a}]")
    with pytest.raises(QueryError):
        Loader().load("rules: [{name: a, type: odd, pattern: a}]")
    with pytest.raises(QueryError):
        Loader().load("rules: [{name: a, pattern: a}]")


@given(st.text(min_size=1, max_size=12))
def test_quoted_words_read_back(w):
    assert parse_basic(f"[raw={T.quote_word(w)}]")[1] == ("eq", "raw", T.nfkc(w))
    assert parse_basic(f"[raw={T.quote_label(w)}]")[1] == ("eq", "raw", T.nfkc(w))


def test_quantifier_text():
    q = T.quantifier
    assert [q(1, 1), q(0, 1), q(0, None), q(1, None), q(2, 2), q(0, 3), q(2, None), q(1, 3, True)] == ["", "?", "*", "+", "{2}", "{,3}", "{2,}", "{1,3}?"]


def test_highlight():
    assert T.highlight(["a", "<b>", "c"], (0, 2), [("x", 1, 2)]) == '<mark>a</mark> <mark class="capture" title="x">&lt;b&gt;</mark> c'
    assert "\x1b[93m" in T.highlight(["a"], (0, 1), style="console")


def test_bad_documents_are_set_apart(spark):
    from loomspan.sources import corpus

    d = corpus.from_strings(spark, [document("ok", BECKY), "{", '{"id": "x", "sentences": [{"numTokens": 2, "fields": [{"$type":"TokensField","name":"raw","tokens":["a"]}]}]}', document("long", sentence("a " * 101), sentence("b"))])
    assert d.filter("error is not null").count() == 2
    assert sorted((r.doc_id, r.sent_id) for r in corpus.sentences_of(d).collect()) == [("long", 1), ("ok", 0)]
