import random
import re
from collections import Counter

import numpy as np
from compare import DATA, database, rows

from mnemara.llm import colloc


def plain(docs, least=30, top=2000, absorbed=80):
    """All phrases counted one by one."""
    f, n = {}, Counter()
    for lang, text in docs:
        lang = lang or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    c = f.setdefault(lang, Counter())
                    c[tuple(w[i : i + k])] += 1
    out = set()
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            longer = [b for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= absorbed * a for b in longer):
                continue
            score, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


def sample(seed, n=300):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Été", "a-b", "\x01x", "日本", "river", "MILL", "to", "é", "z z", "old", "stone", "x'"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    out = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randint(0, 40)):
            text += rng.choice(["of the old mill", "New York", "a-b of"]) if rng.random() < 0.15 else rng.choices(vocabulary, weights)[0]
            text += rng.choices([" ", "\t", ". ", ",", "\n", "\r\n", "; "], [30, 2, 2, 1, 1, 1, 1])[0]
        out.append((rng.choice(["en", "en", "en", "fr", None, "und"]), text))
    return [*out, ("de", "only once"), ("en", None), ("en", ""), *out[:3]]


def got(df):
    return {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


def frame(spark, docs):
    return spark.createDataFrame([(i, *d, 1, "x") for i, d in enumerate(docs)], "doc_id long, lang string, text string, n long, phrase string")


def test_equals_brute_force(spark, monkeypatch):
    docs = sample(1)
    want = plain(docs)
    assert len(want) > 30 and got(colloc.collocations(frame(spark, docs))) == want
    assert got(colloc.collocations(frame(spark, docs).repartition(5), least=5, top=20)) == plain(docs, 5, 20)


def test_small_shards_groups_and_bitmaps_change_nothing(spark, monkeypatch):
    docs = sample(2)
    for name, value in (("SHARD", 500), ("PIECE", 300), ("UNITE", 50), ("QUERIES", 40), ("MAX_BITS", 1 << 16)):
        monkeypatch.setattr(colloc, name, value)
    assert got(colloc.collocations(frame(spark, docs), least=10)) == plain(docs, 10)


def test_query_equals_sql_with_candidates(spark):
    q, con = colloc.op12_collocations(spark, f"{DATA}/sf0.01").toPandas(), database("sf0.01")
    want = con.execute(colloc.OP12_SQL).df()
    assert len(want) > 100 and rows(q) == rows(want)


def test_automata(monkeypatch):
    rng = np.random.default_rng(1)
    words = [b"a", b"b", b"bb", b"c", b"\xc3\xa9"]
    parts, total = [], Counter()
    for _ in range(6):
        table = rng.integers(0, 5, (80, 3)).astype(np.int32)
        total.update(tuple(words[i] for i in r) for r in table.tolist())
        parts.append(colloc.Automaton.from_sorted(*colloc.summed(list(table.T), 6), words))
    whole = colloc.Automaton.unpack(colloc.Automaton.union(parts).pack())
    assert {tuple(whole.words[i] for i in r): w for r, w in zip(whole.rows().tolist(), whole.weights.tolist(), strict=True)} == dict(total)
    cut = dict(whole.cut([(b"a", b"c"), (b"b",), (b"b",), (b"zz",)]))
    assert sum(len(a.weights) for a in cut.values()) == len(whole.weights) and 2 not in cut
    assert all(tuple(cut[0].words[i] for i in r) < (b"a", b"c") for r in cut[0].rows())
    queries = [[b"a", b"b", b"c"], [b"zz", b"b", b"c"], [b"b", b"bb", b"b"], [b"c", b"c", b"zz"]]
    assert whole.find(queries).tolist() == [total[tuple(q)] for q in queries]
    none = colloc.Automaton.from_sorted(np.zeros((0, 2), np.int32), np.zeros(0, np.int64), [])
    assert colloc.Automaton.unpack(none.pack()).find([[b"a", b"b"]]).tolist() == [0]


def test_odd_documents_and_empty_table(spark, odd_docs, no_docs):
    assert colloc.collocations(no_docs).count() == 0
    found = got(colloc.collocations(odd_docs))
    assert {r[2] for r in found} == {"word word word word"} and all(r[0] == "en" for r in found)
