import math
import random
import re

import pytest
import xxhash
from compare import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemara.llm import toxicity


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 8))
def test_index_is_exact(seed, k):
    rng = random.Random(seed)
    idf = [1 + rng.random() for _ in range(6)]

    def some():
        return toxicity.unit_vector(tuple(sorted({rng.randrange(6) for _ in range(rng.randint(1, 4))})), idf)

    examples = [(i, rng.randint(0, 1), some()) for i in range(rng.randint(1, 60))]
    index = toxicity.BlockMaxIndex.build(examples, 6, block=4)
    query = some()
    plain = []
    for i, y, v in examples:
        s = sum(w * dict(v).get(t, 0.0) for t, w in query)
        if s > 0:
            plain.append((round(s, 9), -i, y))
    plain = [(s, -i, y) for s, i, y in sorted(plain, reverse=True)[:k]]
    assert index.nearest(query, k) == [(pytest.approx(s), i, y) for s, i, y in plain]


def test_terms_are_words_and_beginnings_by_occurrence():
    t = toxicity.Terms([("bad", 1), ("bad*", 2), ("ugly", 2), ("badl*", 1), ("bad*", 5)])
    assert t.find("Bad, badly BAD-bad ugly2 ugly. xbad") == (0, 1, 3)
    assert t.find("") == () == t.find(None) and toxicity.Terms([]).find("bad") == ()


def test_one_of_terms_that_stand_for_each_other():
    found = [("idio*", 1, 30, 30), ("idiot", 1, 30, 30), ("lowe*", 1, 90, 90), ("loweia", 1, 20, 20), ("lowei*", 1, 50, 50), ("lowe*", 2, 80, 80)]
    assert toxicity.apart(found) == {("idiot", 1), ("lowe*", 1), ("lowe*", 2)}


def test_held_out_accuracy(spark):
    out = toxicity.op10_toxicity(spark, f"{DATA}/sf0.1").toPandas()
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").toPandas()
    held = out.merge(labels, on="doc_id").query("held_out")
    hit = (held.predicted == 1) & (held.toxic == 1)
    assert len(out) == 10_000 and out.score.between(0, 1).all()
    assert hit.sum() / (held.predicted == 1).sum() > 0.97 and hit.sum() / held.toxic.sum() > 0.85


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 1, 0), (None, 1, 1), (6, 1, None), (8, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd_docs, labels)
    out = toxicity.score_documents(odd_docs, model).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in out)
    kept = toxicity.drop_toxic(odd_docs, labels)
    assert kept.schema == odd_docs.schema and kept.count() <= odd_docs.count()
    assert toxicity.score_documents(no_docs, model).count() == 0
    nothing = toxicity.fit(odd_docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score_documents(odd_docs, nothing).collect()} == {0.0}
    assert toxicity.drop_toxic(no_docs, labels.limit(0)).count() == 0


def test_labelled_words_decide(spark):
    rng = random.Random(0)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(60)]
        if i % 4 == 0:
            text[rng.randrange(60)] = "Vile!" if i % 8 else "awful,"
        rows.append((i, " ".join(text)))
        labels.append((i, 0, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = toxicity.score_documents(docs, toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert all((r["score"] >= toxicity.THRESHOLD) == (r["doc_id"] % 4 == 0) for r in out)


def test_rare_words_beyond_the_sample_decide(spark):
    """A toxic word that the bounded sample hardly sees, among many others, is a term and has its examples."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(4000):
        text = [rng.choice(words) for _ in range(40)]
        if i % 10 == 0:
            text[rng.randrange(40)] = "zyrgh" if i % 200 == 0 else "vile"
        rows.append((i, " ".join(text)))
        labels.append((i, 0, int(i % 10 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_examples=200)
    assert {("zyrgh", 1), ("vile", 1)} <= set(model.terms)
    assert model.idf[model.terms.index(("vile", 1))] == pytest.approx(math.log(4001 / 381) + 1)
    out = toxicity.score_documents(docs, model).collect()
    assert all((r["score"] >= toxicity.THRESHOLD) == (r["doc_id"] % 10 == 0) for r in out)


def test_many_terms_are_met_in_blocks_and_shards(spark):
    """Beyond ``max_terms`` the vocabulary and the examples stay tables: the same scores and neighbours for every row."""
    rng = random.Random(5)
    words, bad = [f"w{i}" for i in range(300)], [f"x{i}{'abcdefgh'[i]}q" for i in range(8)]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(30)]
        for _ in range(i % 3 and rng.randint(0, 2)):
            text[rng.randrange(30)] = rng.choice(bad)
        labels.append((i, 0, int(any(w in bad for w in text) and rng.random() < 0.9)))
        rows.append((i, " ".join(text), "s"))
    rows += [rows[1], rows[1], (None, rows[2][1], None), (None, None, None), (1000, "", "s"), (1, "other x0aq", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one, many = toxicity.fit(docs, labels, 50), toxicity.fit(docs, labels, 50, max_terms=3)
    assert one.spread is None and many.spread.blocks >= 5 and many.spread.shards >= 2 and not many.terms
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 6), r["neighbours"])
    a, b = (sorted(map(key, toxicity.score_documents(docs, m).collect())) for m in (one, many))
    assert len(a) == len(rows) and a == b and len({r[2] for r in a}) > 20
    whole, spread = toxicity.drop_toxic(docs, labels), toxicity.drop_toxic(docs, labels, max_terms=3)
    assert whole.schema == spread.schema and 0 < whole.count() < len(rows)
    assert sorted(map(str, whole.collect())) == sorted(map(str, spread.collect()))


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_group(text):
    """The eight least of all shingle hashes, one after the other."""
    words, mask = plain_words(text), 2**64 - 1
    hashes = set()
    for three in zip(words, words[1:], words[2:], strict=False):
        a, b, c = (xxhash.xxh64_intdigest(w) for w in three)
        h = (a * 0x9E3779B185EBCA87 & mask) ^ (b * 0xC2B2AE3D27D4EB4F & mask) ^ c
        hashes.add((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & mask)
    return tuple(sorted(hashes)[:8]) if hashes else tuple(words)


def plain_terms(text):
    """Every word and every beginning of 4 to 7 letters, counted one by one."""
    count = {}
    for word in plain_words(text):
        for term in [word] + [word[:n] + "*" for n in range(4, 8) if n <= len(word)]:
            count[term] = count.get(term, 0) + 1
    return count


def plain_apart(found):
    """From long to short: a beginning goes if a kept term under it has nine tenths of its hits at about its rate or more,
    else the kept terms under it go whose rate is about its own or less."""
    kept = []
    for term, level, hit, df in sorted(found, key=lambda r: (-len(r[0].strip("*")), "*" in r[0], r)):
        under = [k for k in kept if "*" in term and k[1] == level and k[0].startswith(term[:-1])]
        if not any(k[2] >= 0.9 * hit and k[2] / k[3] >= hit / df - 0.02 for k in under):
            kept = [k for k in kept if k not in under or k[2] / k[3] > hit / df + 0.02] + [(term, level, hit, df)]
    return {k[:2] for k in kept}


def plain_op10(docs, labels, max_examples=10_000):
    """The whole operator once more in plain Python, with a search of every example."""
    import zlib
    from collections import defaultdict

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    label = {}
    for r in labels:
        if r["toxic"] is not None and r["doc_id"] is not None and not held(r["doc_id"]):
            label[r["doc_id"]] = max(r["toxic"], label.get(r["doc_id"], 0))
    groups = {}
    for r in docs:
        if r["doc_id"] in label:
            words = plain_words(r["text"])
            shingles = frozenset(zip(words, words[1:], words[2:], strict=False)) or tuple(words)
            key = (plain_group(r["text"]), label[r["doc_id"]])
            groups.setdefault(key, []).append((r["doc_id"], r["text"], shingles))
    assert all(len(x[2] & y[2]) / len(x[2] | y[2]) > 0.5 for g in groups.values() for x in g for y in g[:1] if isinstance(x[2], frozenset))
    examples = [(min(g)[0], min(g)[1], y) for (_, y), g in groups.items()]
    n, toxic = len(examples), sum(y for *_, y in examples)
    count = defaultdict(lambda: [0, 0])
    for _, text, y in examples:
        for term, c in plain_terms(text).items():
            for level in toxicity.LEVELS:
                if c >= level:
                    count[term, level][0] += 1
                    count[term, level][1] += y
    count = {k: v for k, v in count.items() if v[0] >= toxicity.MIN_SUPPORT}
    least = toxicity.MIN_G2 + 2 * math.log(max(1, len(count)))
    found = []
    for (term, level), (df, hit) in count.items():
        cells = ((hit, df * toxic / n), (df - hit, df * (n - toxic) / n), (toxic - hit, (n - df) * toxic / n), (n - toxic - df + hit, (n - df) * (n - toxic) / n))
        if 2 * sum(o * math.log(o / e) for o, e in cells if o) >= least and hit > df * toxic / n and hit >= df * toxicity.MIN_RATE:
            found.append((term, level, hit, df))
    space = plain_apart(found)
    have = {r["doc_id"]: {(t, v) for t, c in plain_terms(r["text"]).items() for v in toxicity.LEVELS if c >= v and (t, v) in space} for r in docs}
    df = {k: sum(k in x for x in have.values()) for k in space}
    idf = {k: math.log((1 + len(docs)) / (1 + df[k])) + 1 for k in space}

    def unit(terms):
        size = math.sqrt(sum(idf[t] ** 2 for t in terms))
        return {t: idf[t] / size for t in terms}

    index = [(i, y, unit(have[i])) for i, _, y in examples if have[i]]
    assert len(index) <= max_examples
    blank = [y for i, _, y in examples if not have[i]]
    base = toxic / n
    out = {}
    for r in docs:
        q = unit(have[r["doc_id"]]) if have[r["doc_id"]] else {}
        near = sorted(((-round(sum(w * v.get(t, 0) for t, w in q.items()), 9), i, y) for i, y, v in index if any(t in v for t in q)))[: toxicity.K]
        w = [1 / (0.05 + max(0.0, 1 + s)) for s, _, _ in near]
        votes = sum(x for x, (_, _, y) in zip(w, near, strict=True) if y)
        out[r["doc_id"]] = (votes + 0.5 * base) / (sum(w) + 0.5) if near else (sum(blank) + 0.5 * base) / (len(blank) + 0.5)
    return space, out


def test_whole_operator_against_a_plain_version(spark):
    """Features, frequencies, neighbours and votes for every document of a table whose ids are its own."""
    sf = f"{DATA}/sf0.01"
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    labels = [r.asDict() for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert len({r["doc_id"] for r in docs}) == len(docs)
    space, want = plain_op10(docs, labels)
    assert space
    got = {r["doc_id"]: r["score"] for r in toxicity.op10_toxicity(spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_sketches_tell_copies_from_shared_passages():
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    shared, same = words(150), 0
    texts = [" ".join(words(150) + shared) for _ in range(300)]
    assert len({toxicity.sketch(t) for t in texts}) >= 298
    for t in texts[:100]:
        near = t.split()
        near[rng.randrange(300)] = "other"
        same += toxicity.sketch(" ".join(near)) == toxicity.sketch(t.upper())
    assert same >= 80 and toxicity.sketch(None) == toxicity.sketch("") and toxicity.sketch("a a a " * 500) == toxicity.sketch("a a a " * 600)
