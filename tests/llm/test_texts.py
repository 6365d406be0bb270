import os
import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from zenithal.llm import common, langid, ngram_join, pii, queries, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, key string, leader string, n string, score string, lang_pred string")


def padded(rows):
    return [(i, t, "k", "l", "n", "s", "p") for i, t in rows]


# ---------------------------------------------------------------- kernels


MEMORY = """
import re, sys
import numpy as np, pyarrow as pa
from zenithal.llm.common import lean

def held():  # MB without mapped files
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def run(batches):
    small = []
    for batch in batches:
        small.append([bytes(100 + i % 400) for i in range(100_000)])  # from the heap, not as mappings of their own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 << 20))], ["x"])

batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(1 << 18))], ["x"])]
before = held()
n = sum(len(b) for b in lean(run)(iter(batches * 4)))
print(n, held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_workers_give_memory_back():
    said = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.path.abspath(f"{common.__file__}/../../..")})
    rows, more = said.stdout.split()
    assert int(rows) == 4 << 20 and float(more) < 24


@pytest.mark.parametrize("n", [0, 1, 3, 4, 500])
def test_frequent_values(n):
    parts = [np.random.default_rng(n + k).integers(0, max(2, n // 5), n).astype(np.uint64) for k in range(2)]
    h, c = np.unique(np.concatenate(parts), return_counts=True)
    got = common.frequent_values(parts, 4)
    assert [x.tolist() for x in got] == [h[c >= 4].tolist(), c[c >= 4].tolist()] and not parts
    assert common.frequent_values([], 2)[0].dtype == np.uint64


def test_word_kernels():
    import pyarrow as pa

    texts = ["One two", None, "", "  x ", "two\u000bOne é", "one"]
    data, offsets = common.flat(pa.array(texts))
    starts, ends, first = common.word_bounds(data, offsets)
    words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert words == [w for t in texts for w in WORD.findall(t or "")] and list(np.diff(first)) == [len(WORD.findall(t or "")) for t in texts]
    h = common.word_hashes(data, starts, ends)
    assert h[0] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 5
    w = common.window_hashes(np.array([3, 5, 7, 3, 5, 7, 9], np.uint64), 3)
    assert w[0] == w[3] and len(set(w.tolist())) == 4


# ---------------------------------------------------------------- n-gram join


def brute_components(rows, n, num, den):
    sets, up = {}, {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        up[i] = i

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = list(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    base, rows = [words[i] for i in rng.integers(0, 300, 60)], []
    for i in range(120):  # one large group of near copies
        b = list(base)
        for _ in range(rng.integers(0, 5)):
            b[rng.integers(0, 60)] = words[rng.integers(0, 300)]
        rows.append((i, " ".join(b)))
    for i in range(120, 200):  # a chain that drifts
        base = list(base)
        base[rng.integers(0, 60)] = words[rng.integers(0, 300)]
        rows.append((i, " ".join(base)))
    rows += [(i, " ".join(words[k] for k in rng.integers(0, 6, rng.integers(1, 10)))) for i in range(200, 300)]
    return rows + [(300, ""), (301, None), (302, "  "), (303, "One"), (304, "one"), (305, "É one"), (306, "é one"), (307, rows[0][1])]


@pytest.mark.parametrize(("n", "num", "tile"), [(4, 85, 512), (2, 60, 32)])
def test_ngram_join_is_brute_force(spark, monkeypatch, n, num, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rows = near_copies()
    got = ngram_join.components(documents(spark, padded(rows)), n, num, 100).toPandas()
    want = brute_components(rows, n, num, 100)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want
    assert sum(c != i for i, (_, c) in want.items()) > 100


def test_ngram_join_edges(spark):
    got = ngram_join.components(documents(spark, padded([(None, "a b c d e"), (1, "a b c d e"), (2, None)]))).toPandas()
    assert len(got) == 3 and set(got.component_id.dropna()) == {1, 2}
    assert ngram_join.components(documents(spark, padded([])), 4).count() == 0


def test_bitmap_never_refuses_similar_sets():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.08], rng.integers(0, 1 << 63, int(n * 0.08)).astype(np.uint64)]))
        if len(y) and ngram_join.similar(x, y, 80, 100):
            assert ngram_join.admissible(ngram_join.bitmap(x), ngram_join.bitmap(y), len(x), len(y), 80, 100)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(100, 7), (7, 7), (3, 100), (100, 3)], "a long, b long")
    got = {r.id: r.component for r in common.connected_components(edges).df.collect()}
    assert got == {i: 10 for i in range(10, 41)} | {3: 3, 7: 3, 100: 3}


def test_components_of_random_links(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)]
    least = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in least:
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long")).df.collect()}
    assert got == least


def test_components_of_stars_write_few_files(spark, monkeypatch):
    written = []

    class Counted(common.Kept):
        def __init__(self, *args):
            super().__init__(*args)
            written.append(len(self.df.inputFiles()))

    monkeypatch.setattr(common, "Kept", Counted)
    edges = spark.createDataFrame([(i % 7, i) for i in range(7, 700)], "a long, b long")
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.id: r.component for r in common.connected_components(edges).df.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i % 7 for i in range(700)}
    assert len(written) == 2 and max(written) <= common.FILES


# ---------------------------------------------------------------- suffix dedup


def brute_repeats(rows, length):
    seen, words = {}, {}
    for i, t in rows:
        words[i] = WORD.findall(t or "")
        for a in range(len(words[i]) - length + 1):
            seen.setdefault(tuple(words[i][a : a + length]), []).append((i, a))
    rep, cut = {}, {}
    for found in seen.values():
        first = min(found)[0]
        if any(i != first for i, _ in found):
            for i, a in found:
                rep.setdefault(i, set()).update(range(a, a + length))
                if i != first:
                    cut.setdefault(i, set()).update(range(a, a + length))
    return rep, cut, words


@pytest.mark.parametrize(("longest", "around"), [(suffix_dedup.RUN, suffix_dedup.AROUND), (5, suffix_dedup.AROUND), (5, 3)])
def test_suffix_dedup_is_brute_force(spark, longest, around):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(400)]
    passages = [[words[i] for i in rng.integers(0, 400, rng.integers(15, 60))] for _ in range(20)]
    rows = []
    for i in range(250):
        w = []
        for _ in range(rng.integers(0, 5)):
            p, a = passages[rng.integers(0, 20)], rng.integers(0, 10)
            w += [words[k] for k in rng.integers(0, 400, rng.integers(0, 30))] + p[a : a + rng.integers(10, 60)]
        rows.append((i, " ".join(w + ["x"] * (int(rng.integers(10, 100)) if i % 40 == 0 else 0))))
    rows += [(250, None), (251, ""), (252, "a b"), (253, rows[3][1])]
    df = documents(spark, padded(rows)).select("*", F.lit(1).alias("_from"), F.lit(2).alias("a"), F.lit(3).alias("row"))
    spans = suffix_dedup.repeats(df, 20, 8, longest=longest, most_around=around)
    rep, cut, words_of = brute_repeats(rows, 20)
    got, got_cut = {}, {}
    for r in spans.collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        for a, b in zip(r.cut_starts, r.cut_ends):
            got_cut.setdefault(r.doc_id, set()).update(range(a, b))
    assert got == rep and got_cut == cut and rep
    left = {r.doc_id: WORD.findall(r.text or "") for r in suffix_dedup.without_repeats(df, spans).collect()}
    for i, w in words_of.items():
        stay = [x for k, x in enumerate(w) if k not in cut.get(i, ())]
        assert left.get(i, []) == stay and (i in left or (w and not stay))


def test_suffixes_extend_to_both_sides():
    """Runs of 6 words around heads of 3: every combination of words left and right, against all runs in plain Python."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{k}" for k in [*rng.integers(0, 2, 3), 7, 8, 9, *rng.integers(0, 2, 3)]) for _ in range(40)]
    runs = suffix_dedup.Runs(pa.array(texts), 6, 4)
    doc, head, at, lo, hi = runs.suffixes()
    after, before = (suffix_dedup._padded(x, 3) for x in runs.sides(at, lo, hi))
    order = np.lexsort((*after.T[::-1], head))
    leader, several = suffix_dedup.compare(head[order].view(np.int64), doc[order], lo[order], hi[order], after[order], before[order])
    place = (at - runs.first[:-1][doc])[order]
    got = {(int(doc[order][r]), int(place[r]) - o): int(leader[r, o]) for r, o in zip(*np.nonzero(several))}
    seen = {}
    for i, t in enumerate(texts):
        w = t.split()
        for a in range(len(w) - 5):
            seen.setdefault(tuple(w[a : a + 6]), []).append((i, a))
    assert got == {x: min(found)[0] for found in seen.values() if len({i for i, _ in found}) > 1 for x in found}


def test_suffix_dedup_leaves_clean_documents(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(str(rng.randrange(10**6)) for _ in range(200))) for i in range(20)]
    rows.append((99, " ".join(["same words again"] * 60)))  # repeats itself alone
    assert suffix_dedup.repeats(documents(spark, padded(rows))).count() == 0


# ---------------------------------------------------------------- language, toxicity


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op4_language_id(spark, SF).join(docs, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 200 and (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(1, "the cat and the dog sat on the mat with the hat", "en"), (2, "der hund und die katze sind nicht auf dem dach", "de"), (3, "le chat et le chien ne sont pas sur le toit", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    texts = [None, "", "123 !?", "und die", "the dog", "the dog " * 400_000]
    out = langid.predict(documents(spark, padded(list(enumerate(texts)))), model, names=("_l", "_s")).toPandas().set_index("doc_id")
    assert list(out["_l"].sort_index()) == ["und", "und", "und", "de", "en", "en"] and out.loc[0, "_s"] == 0
    none = langid.fit(spark.createDataFrame([], "text string, lang string"))
    assert none.predict(["the dog"])[0] == ["und"]


def test_profiles_are_bundles_of_bound_letters():
    p = langid.profiler(256, 3)
    whole, _ = p.bundles(["abc"])
    slot = lambda c: p.slot[ord(c)]
    want = 0
    for a, b, c in (" ab", "abc", "bc "):
        want = want + p.rolled[0][slot(a)].astype(int) * p.rolled[1][slot(b)] * p.rolled[2][slot(c)]
    assert (whole[0] == want).all()


def test_toxicity_finds_insults(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, " ".join([word() for _ in range(30)] + (["nasty", "brute"][: 1 + i % 2] if bad else []))))
        labels.append((i, int(bad)))
    docs, lab = documents(spark, padded(rows)), spark.createDataFrame(labels + [(9999, 1), (3, None)], "doc_id long, toxic int")
    voter = toxicity.fit(lab.where("doc_id < 200 or doc_id = 9999"), docs)
    got = toxicity.score(docs, voter, keep=["doc_id"]).toPandas().set_index("doc_id")
    assert all((got.loc[i, "score"] >= 0.5) == bool(y) for i, y in labels)
    assert len(got.loc[200, "evidence"]) > 0
    edge = toxicity.score(documents(spark, padded([(1, None), (2, ""), (3, "zz")])), voter, keep=[]).toPandas()
    assert edge.score.between(0, 0.5).all() and not edge.evidence.map(len).any()
    assert toxicity.score(docs, None, keep=["doc_id"]).select("score").distinct().count() == 1


def test_toxicity_sees_rare_insults(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    insults = [f"zz{chr(97 + i // 26)}{chr(97 + i % 26)}q" for i in range(100)]  # each in about 2 % of the examples of class 1
    rows = [(i, " ".join([word() for _ in range(30)] + ([insults[i // 4 % 100], insults[(i // 4 + 7) % 100]] if i % 4 == 0 else []))) for i in range(1200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows if i < 800], "doc_id long, toxic int")
    voter = toxicity.fit(labels, documents(spark, padded(rows)))
    assert all(w in voter.terms for _, t in rows[:800] for w in t.split())
    got = toxicity.score(documents(spark, padded(rows[800:])), voter, keep=["doc_id"]).toPandas()
    bad = got.doc_id % 4 == 0
    assert (got.score[bad] >= 0.5).mean() > 0.9 and (got.score[~bad] >= 0.5).mean() < 0.05 and got.evidence.map(len).min() > 0


def terms_of(text):
    found = re.findall(r"[^\W\d_]+", (text or "").lower())
    return Counter(found + [w[:5] + "*" for w in found if len(w) > 5])


def test_toxicity_is_brute_force(spark):
    """The registered query's neighbours over whole texts, against cosines of all words in plain Python."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = queries._fold("doc_id", 5) == 0
    voter = toxicity.fit(labels.where(~held), docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    counts = {i: terms_of(t) for i, t in texts.items()}
    known = {w for i in voter.ids[: voter.n].tolist() for w in counts[i]}
    number = {w: int(voter.terms.find(np.array([toxicity.word_hash(w)]))[1][0]) for w in known}
    assert len(set(number.values())) == len(number) == voter.v

    def unit(c):
        w = {t: (1 + np.log(n)) * voter.idf[number[t]] for t, n in c.items() if t in number}
        size = sum(x * x for x in w.values()) ** 0.5
        return {t: x / size for t, x in w.items()}

    examples = {i: unit(counts[i]) for i in voter.ids[: voter.n].tolist()}
    with_term = Counter(w for c in counts.values() for w in c)
    assert max(with_term.values()) > min(with_term.values())
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, c in counts.items():
        mine = unit(c)
        cosines = sorted(((-round(sum(x * e.get(t, 0) for t, x in mine.items()), 9), j) for j, e in examples.items() if mine.keys() & e.keys()))[: voter.k]
        assert list(got[i].similarity) == pytest.approx([-s for s, _ in cosines], abs=1e-8)
        assert len(got[i].evidence) == len(cosines)


def test_tokens_of_long_texts(monkeypatch):
    text = "Äpfel und Birnen, straße_2 x9 " * 50 + "langeswort" * 30
    whole = toxicity.Terms(np.unique(toxicity.tokens([(0, text.lower())])[1])).counts([text, None, text])
    monkeypatch.setattr(toxicity, "CHARS", 64)
    parts = toxicity.Terms(np.unique(toxicity.tokens([(0, text.lower())])[1])).counts([text, None, text])
    assert all((a == b).all() for a, b in zip(whole, parts)) and set(whole[0]) == {0, 2}
    want = terms_of(text)
    assert sorted(whole[2][whole[0] == 0].tolist()) == sorted(want.values())


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    tf = [dict(Counter(rng.integers(0, 40, rng.integers(0, 9)).tolist())) for _ in range(700)]
    labels = rng.integers(0, 2, 700).astype(float)
    v = toxicity.Voter([f"t{i}" for i in range(40)], rng.random(40) + 0.5, np.arange(700), tf, labels, np.ones(700), 7)
    dense = v.posting.reshape(40, -1)
    for _ in range(100):
        t, w = v.vector(dict(Counter(rng.integers(0, 40, 5).tolist())))
        s = w @ dense[t]
        order = np.lexsort((v.ids, -np.round(s, 12)))[:7]
        places, scores = v.nearest(t, w)
        assert list(v.ids[places]) == list(v.ids[order]) and np.allclose(scores, s[order])


# ---------------------------------------------------------------- personal data

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15],
    }


@pytest.mark.parametrize("alphabet", ["a@.b-1", "01.9 -+()", "1.25", "ab@. 1+(é", "4 -1"])
def test_plain_spans_are_those_of_the_patterns(alphabet):
    rng = random.Random(4)
    for _ in range(4000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 50)))
        assert pii.plain_spans(t) == plain(t), t


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john.doe at example dot com now", "email", "john.doe at example dot com"), ("to bob (at) mail [dot] example (dot) org.", "email", "to bob (at) mail [dot] example (dot) org"[3:]), ("call plus one four one five five five five two six seven one please", "phone", "plus one four one five five five five two six seven one"),
        ("at 192 dot 168 dot 1 dot 1 now", "ip", "192 dot 168 dot 1 dot 1"), ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"), ("x jоhn@exаmple.com y", "email", "jоhn@exаmple.com"), ("no. four one one one one one one one one one one one one one one one.", "card", "four one one one one one one one one one one one one one one one"),
    ],
)
def test_disguises(text, kind, found):
    base, added = pii.find(text)
    assert [text[a:b] for a, b in added[kind]] == [found] or [text[a:b].lstrip() for a, b in added[kind]] == [found]
    assert f"[{kind.upper()}]" in pii.redact(text)


@pytest.mark.parametrize("text", ["he was at home. The dot was at one place dot", "look at this. Then", "one two buckle my shoe", "ésta señal größe naïve", "(at) the door", "1.2.3.4 and a@b.c"])
def test_clean_texts_gain_nothing(text):
    assert not any(pii.find(text)[1].values())


@pytest.mark.parametrize("text", ["write john @ example.com now", "write john_at_example.com now", "write john-at-example.com now", "call +1 five 5 five 0 one 9 nine 4 seven"])
def test_disguises_without_other_signs(text):
    assert sum(map(len, pii.find(text)[1].values())) == 1


def test_the_gate_is_no_narrower_than_the_transducers(monkeypatch):
    rng = random.Random(9)
    parts = ["john", "example.com", "com", "@", " @ ", " at ", "_at_", "-AT-", " dot ", "_dot_", " Dot  ", ".", " ", " ", "-", "_", ", ", "+", "1", "5", "930", "five", "Nine", "oh", "plus ", "O1", "(at)", "[dot]", "a", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(2, 24))) for _ in range(30000)]
    gated = [pii.find(t) for t in texts]
    monkeypatch.setattr(pii, "disguised", lambda t: True)
    for t, got in zip(texts, gated, strict=True):
        assert got == pii.find(t), t


def test_pii_over_rows(spark):
    df = documents(spark, padded([(1, "a@b.co and +1 (930) 555-2361"), (2, None), (3, ""), (4, "9" * 50000), (5, "a@" * 20000)]))
    got = {r.doc_id: r for r in pii.spans(df).collect()}
    assert got[1].spans == "email:0:6,phone:11:28" and got[2].spans == got[3].spans == "" and got[4].n_card == 0 and got[5].n_email == 0
    red = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert red[1] == "[EMAIL] and [PHONE]" and red[2] is None


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.toPandas()
    for name, stage in corpus_pipeline.STAGES:
        out = common.Kept(stage(spark, docs, SF), "test").df
        after = out.toPandas()
        if name != "packing":
            assert after.columns.tolist() == before.columns.tolist() and set(after.doc_id) <= set(before.doc_id) and after.doc_id.is_unique
        if name == "near_duplicates":
            want = brute_components(list(zip(before.doc_id, before.text)), 5, 80, 100)
            assert set(after.doc_id) == {i for i, (_, c) in want.items() if i == c}
        if name == "repeated_passages":
            _, cut, words = brute_repeats(list(zip(before.doc_id, before.text)), 50)
            for r in after.itertuples():
                assert WORD.findall(r.text) == [w for k, w in enumerate(words[r.doc_id]) if k not in cut.get(r.doc_id, ())]
        if name == "language":
            model = langid.fit(docs)
            lang, likeness = model.predict(before.text.tolist())
            gone = {i for i, t, n, s in zip(before.doc_id, before.text, lang, likeness) if n == "und" or (s < 3 / 32 and len(t) >= 64)}
            assert set(before.doc_id) - set(after.doc_id) == gone and {i for i, t in zip(before.doc_id, before.text) if not re.search(r"[^\W\d_]", t or "")} <= gone
        if name == "personal_data":
            texts = {r.doc_id: r.text for r in after.itertuples()}
            for r in before.itertuples():
                found = sorted((a, b, k) for k, spans in plain(r.text).items() for a, b in spans)
                assert not any(t in texts[r.doc_id] for t in (r.text[a:b] for a, b, k in found if k in ("email", "card")))
                want, at = [], 0  # plain data alone, where nothing is disguised and nothing overlaps
                for a, b, k in found:
                    want += [r.text[at:a], f"[{k.upper()}]"]
                    at = b
                if not any(pii.find(r.text)[1].values()) and all(x[1] <= y[0] for x, y in zip(found, found[1:])):
                    assert texts[r.doc_id] == "".join([*want, r.text[at:]])
        if name == "packing":
            assert set(after.doc_id) == set(before.doc_id)
        docs, before = out, after


def test_pipeline_edges(spark):
    """Rows that repeat, share an id or have none, clashing columns, random letters: what each stage keeps."""
    rng = random.Random(2)
    words = ["the", "cat", "and", "dog", "sat", "with", "hat", "under", "house", "long", "night", "green"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, b, c = prose(80), prose(80), prose(80)
    noise = "".join(rng.choice("qxzjkvw") for _ in range(400))
    rows = [(1, a), (1, a), (2, a), (3, b), (3, c), (None, b), (None, b), (4, ""), (5, None), (6, "12 !?"), (7, "ok"), (8, noise)]
    names = "doc_id long, text string, lang string, id string, likeness string, a string, _from string"
    docs = spark.createDataFrame([(i, t, "en" if i != 8 else None, "x", "y", "z", "f") for i, t in rows], names)
    stages = dict(corpus_pipeline.STAGES)
    kept = common.Kept(stages["language"](spark, docs, SF), "test").df
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 1, 2, 3, 3, 7]
    once = common.Kept(stages["near_duplicates"](spark, kept, SF), "test").df
    assert sorted((r.doc_id or 0, r.text) for r in once.collect()) == sorted([(0, b), (1, a), (3, b), (3, c), (7, "ok")])
    cut = stages["repeated_passages"](spark, once, SF)
    assert cut.columns == docs.columns and {r.doc_id for r in cut.collect()} == {None, 1, 3, 7}
    assert stages["packing"](spark, stages["personal_data"](spark, cut, SF), SF).count() >= 4


def test_pipeline_of_nothing(spark):
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": pd.Series([], dtype="int64"), "text": pd.Series([], dtype="str"), "lang": pd.Series([], dtype="str"), "source": pd.Series([], dtype="str"), "n_chars": pd.Series([], dtype="int64")}), "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
