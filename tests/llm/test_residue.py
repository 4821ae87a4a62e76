import duckdb
import numpy as np
import pytest

from brindle.llm import residue
from brindle.llm.residue import BUCKETS, ROWS, classify, count_corpus, find_residue, fit, normal, without_residue

from holdout import TEXTS

DATA = "/root/testdata/sf0.01/documents.parquet"

# Texts that the seeds don't hold as they are, labelled by hand.
CASES = {
    "placeholder": ["Hello {{first_name}}, I bought the kettle last week and it works.", "My review of [INSERT PRODUCT NAME]: sturdy and quiet.", "Danke an %(kunde)s, der Akku hält lange.", "The lid of the <%= order_id %> broke after two days.", "I got ${rating} stars from #{store} on a Tuesday.", "Bonjour [[client]], merci pour la livraison rapide."],
    "filler": ["Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.", "We like it. Vestibulum tortor quam, feugiat vitae, ultricies eget, tempor sit amet.", "asdf asdf asdf asdf", "This is only a test. Test test test test.", "Blindtext Blindtext Blindtext", "Your text goes here. Your text goes here."],
    "notice": ["404 Not Found\nnginx/1.18", "Please enable JavaScript to view this page.", "Access denied. You don't have permission to view this resource.", "Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.", "HTTP/1.1 503 Service Unavailable\nRetry after 30 seconds", "Votre session a expiré. Veuillez vous reconnecter."],
}
NATURAL = [
    "The book explains templates well; I learned what a placeholder is in two days.", "The display shows error 404 when the cable is loose, but after a reset it was fine.", "Chapter 12 tells you to enable JavaScript in the browser, which worked for me.", "Support said the page was not found, then they sent a new lid.", "It prints labels {like this} if you forget the quotes.", "It survived a fall in the garage and still feels solid.",
    "Der Griff ist schön verarbeitet und die Lieferung kam schnell.", "x < y and a > b, 100 % cotton, $5 <br> #1 ~ fine", "ok", "", None, "   ",
]


@pytest.fixture(scope="module")
def tables():
    texts = [normal(t) for (t,) in duckdb.sql(f"SELECT text FROM '{DATA}' WHERE text <> ''").fetchall()]
    counts = np.zeros((ROWS, BUCKETS), np.int64)
    residue._count(texts, counts)
    return fit(counts)


def test_held_out_texts(tables):
    """Texts that neither seeds nor tables hold: nine in ten of each class are found, and ordinary ones that come near are mostly left alone."""
    right, n = {}, {}
    for kinds in TEXTS.values():
        for kind, texts in kinds.items():
            found = classify(tables, texts)
            right[kind] = right.get(kind, 0) + sum(bool(f) != (kind == "natural") for f in found)
            n[kind] = n.get(kind, 0) + len(texts)
    for kind in ("placeholder", "filler", "notice"):
        assert right[kind] >= 0.9 * n[kind], (kind, right, n)
    false = n["natural"] - right["natural"]
    found = sum(right[k] for k in ("placeholder", "filler", "notice"))
    assert found / (found + false) >= 0.9


def test_no_seed_is_a_held_out_text():
    from brindle.llm import seeds

    plain = lambda t: normal(t).strip(" .!。")
    made = {plain(s) for make in (*seeds.CLASSES.values(), seeds.natural) for s in make()}
    shared = {t for kinds in TEXTS.values() for texts in kinds.values() for t in texts if plain(t) in made and len(t) > 30}
    assert shared == set()


def test_shapes():
    t, at = residue.shapes(residue._codes("dear {{first_name}}, my 2 old lamps [insert name here]!"))
    assert "".join(map(chr, t)) == "a {{a_a}}, a 0 a [a]!" and at[0] == 0 and at[2] == 5
    assert "".join(map(chr, residue.shapes(residue._codes("〇〇様、商品{名前}は"))[0])) == "〇〇a、a{a}a"


def test_neighbours_do_not_lend_their_shapes(tables):
    texts = ["my review of {customer_name}", "delivery took 17 days.", "x", "hello {{name}}", "atención al cliente lleva 30 días"]
    assert [bool(f) for f in classify(tables, texts)] == [True, False, False, True, False]


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, v in CASES.items() for t in v])
def test_cases(tables, kind, text):
    assert kind in classify(tables, [text])[0]


@pytest.mark.parametrize("text", NATURAL)
def test_natural_texts(tables, text):
    assert classify(tables, [text])[0] == {}


def test_coverage_and_place(tables):
    texts = [normal("It survived a fall. " + "lorem ipsum dolor sit amet " * 3)]
    marks = residue.windows(tables, texts)["filler"][0]
    assert not marks[:12].any() and marks[30:].all()


def test_long_texts_whole(tables, monkeypatch):
    monkeypatch.setattr(residue, "SPAN", 500)
    monkeypatch.setattr(residue, "OVERLAP", 120)
    prose = "The manual has 12 pages and my neighbour wants one too. " * 40
    late = prose + "Hello {{customer_name}}, thanks."
    notice = "Please enable JavaScript to view this page. " * 30
    got = classify(tables, [prose, late, notice, "404 not found. " + prose])
    assert got[0] == {} and "placeholder" in got[1] and "notice" not in got[1] and got[2]["notice"] > 0.9 and got[3] == {}
    # wherever the parts are cut, a placeholder and a short filler sentence are whole in one of them
    words = "my neighbour wants one too and the lamp is bright " * 30
    for at in range(380, 520, 7):
        for what, kind in (("hello {{customer_name}} thanks ", "placeholder"), ("<br>lorem ipsum dolor sit amet<br>", "filler")):
            assert kind in classify(tables, [words[:at] + " " + what + words[at:]])[0], (at, what)
    parts = list(residue._parts(late))
    assert all(late[lo : lo + len(p)] == p for lo, p in parts) and max(len(p) for _, p in parts) <= 500
    assert all(b[0] <= a[0] + len(a[1]) for a, b in zip(parts, parts[1:])) and parts[-1][0] + len(parts[-1][1]) == len(late)


def test_batches_do_not_touch(tables):
    texts = [t for v in CASES.values() for t in v] + NATURAL
    assert classify(tables, texts) == [classify(tables, [t])[0] for t in texts]


def test_counts_are_of_all_texts(spark):
    rows = [("abcdef",), ("abcdef",), (None,), ("",), ("ab",)]
    df = spark.createDataFrame(rows, "text string").repartition(3)
    counts = count_corpus(df, "text")
    want = np.zeros_like(counts)
    residue._count(["abcdef", "abcdef", "ab"], want[:ROWS])
    assert (counts == want).all() and counts.sum(axis=1).tolist()[:2] == [4, 8]
    assert count_corpus(df.limit(0), "text").sum() == 0


def test_operator(spark):
    docs = spark.read.parquet(DATA).select("doc_id", "text")
    extra = [(900_000 + i, t) for i, t in enumerate([t for v in CASES.values() for t in v] + NATURAL)]
    both = docs.union(spark.createDataFrame(extra, docs.schema)).union(spark.createDataFrame(extra[:1], docs.schema))
    found = find_residue(both.withColumnRenamed("doc_id", "id"), "text", ["id"]).collect()
    ids = sorted(r.id for r in found if r.id >= 900_000)
    assert ids == [900_000, 900_000, *range(900_001, 900_018)]
    assert all(any(r[c] is not None for c in ("placeholder", "filler", "notice")) for r in found)
    with pytest.raises(ValueError):
        find_residue(docs.withColumnRenamed("doc_id", "notice"), "text", ["notice"])
    assert find_residue(docs.limit(0), "text", ["doc_id"]).collect() == []
    kept = without_residue(docs, "text", "doc_id")
    assert kept.count() == docs.count() - find_residue(docs, "text", ["doc_id"]).count()


def test_placeholder_seeds(tables):
    from brindle.llm import seeds

    made = [f"{a}{n}{b}" for n in seeds.FIELD_NAMES for a, b in seeds.MARKS] + ["[your name, city]", "{{" + "your product name and " * 50 + "city}}"]
    found = classify(tables, [f"My neighbour bought the kettle last week and {p} it works well in the kitchen." for p in made])
    missed = [p for p, f in zip(made, found, strict=True) if "placeholder" not in f]
    assert len(missed) < 0.03 * len(made), missed[:50]
    natural = ["The exercise about the undefined variable in chapter 6 is just right.", "My nan loves it and my sister does, too.", "He said: name it, then {press enter} twice.", "It is __very__ good (see photo) & <b>cheap</b>."]
    assert classify(tables, natural) == [{}] * 4


def test_filler_seeds(tables):
    from brindle.llm import seeds

    prose = "My neighbour bought the kettle last week and my sister wants one too"
    forms = ["{}", prose + ". " + prose + ". {}. " + prose + ".", prose + "\n{}\n" + prose, prose + "<br>{}<br/>" + prose]
    made = [f.format(p.rstrip(".。")) for p in dict.fromkeys(seeds.FILLER) if len(p) > 4 and not set(p) & set(".,!") for f in forms]
    assert [t for t, f in zip(made, classify(tables, made), strict=True) if "filler" not in f] == []
    assert classify(tables, [prose + "\n" + prose, prose + "<br>It is good.<br>" + prose]) == [{}, {}]


def test_sure_texts_teach(spark):
    """Nonsense made of words that no seed has is found where it stands beside known nonsense."""
    import random

    pick = random.Random(4)
    words = "sempro nuntula vestaro pharetu ligamo porticus fermosa collum nibulo vitulam".split()
    known = [" ".join(["lorem ipsum dolor sit amet", *pick.choices(words, k=6)]) for _ in range(20)]
    new = [" ".join(pick.choices(words, k=9)) for _ in range(8)]
    docs = spark.read.parquet(DATA).select("doc_id", "text")
    rows = [(10**9 + i, t) for i, t in enumerate(known + new)]
    found = {r.doc_id for r in find_residue(docs.union(spark.createDataFrame(rows, docs.schema)), "text", ["doc_id"]).filter("doc_id >= 1000000000").collect()}
    assert len(found & {i for i, _ in rows[20:]}) >= 7 and len(found & {i for i, _ in rows[:20]}) >= 19


def test_copies_do_not_become_prose(spark):
    docs = spark.read.parquet(DATA).select("doc_id", "text").limit(600)
    said = ["Access denied. You don't have permission to access this resource.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor."]
    n = docs.count() // 4  # each in a quarter as many rows as there are others: both in a third of all
    # the filler closes reviews that differ, the notice is the whole text
    rows = [(10**9 + i, said[0] if i < n else f"My neighbour {i} took lid {chr(97 + i % 26)} home. {said[1]}") for i in range(2 * n)]
    found = find_residue(docs.union(spark.createDataFrame(rows, docs.schema)), "text", ["doc_id"]).filter("doc_id >= 1000000000").collect()
    assert {r.doc_id for r in found if r.notice is not None} == {i for i, _ in rows[:n]}
    assert {r.doc_id for r in found if r.filler is not None} == {i for i, _ in rows[n:]}


def test_distinct_sentences(spark, monkeypatch):
    rows = [("One lid. Two LIDS!",), ("two  lids! One lid.",), ("Lid 12. Lid 34.",), (None,), ("",)]
    df = spark.createDataFrame(rows * 3, "text string").repartition(4)
    assert sorted(r.t for r in residue.distinct_sentences(df, "text").collect() if not r.t.startswith("lid")) == ["one lid.", "two lids!"]
    assert residue.distinct_sentences(df, "text").count() == 3
    assert residue.prose_counts(df.limit(0), "text").sum() == 0


def test_registered():
    import __spark_entry__ as entry

    assert {"p6_ids", "p7_containers", "p8_found"} <= set(entry.queries())
