import random

from mnemara.llm import decontam


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def plain(docs, items, words=10):
    """Every window of every item against every place of every document."""
    out = []
    for doc_id, text in docs:
        w, hit, names = words_of(text), set(), set()
        for item_id, item in items:
            v = words_of(item)
            m = min(len(v), words)
            windows = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else set()
            for i in range(len(w) - m + 1):
                if m and tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    names |= {str(item_id)} if item_id is not None else set()
        out.append((doc_id, len(w), tuple(sorted(hit)), tuple(sorted(names))))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], tuple(p for s in r["spans"] for p in range(s["start"], s["end"])), tuple(r["items"])) for r in df.collect()), key=str)


def sample(seed):
    rng = random.Random(seed)
    some = ["the", "of", "Über", "a1", "river", "mill", "x", "日本", "old", "stone"]

    def text(n):
        return "".join(rng.choice(some) + rng.choice([" ", ", ", "\n", "-", "\x00", "_"]) for _ in range(n))

    items = [(i, text(rng.choice([1, 2, 3, 9, 10, 11, 25]) if i % 4 else rng.randint(12, 20))) for i in range(24)]
    items += [(3, items[5][1]), (None, items[7][1]), (90, None), (91, ""), (92, items[8][1])]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            v = words_of(rng.choice(items)[1])
            cut = rng.randint(0, 6)
            parts += [" ".join(v[cut : cut + rng.randint(5, 20)]).upper(), text(rng.randint(0, 5))]
        docs.append((i, rng.choice([" ", "; "]).join(parts)))
    return [*docs, (7, docs[7][1]), (None, docs[8][1]), (100, None), (101, "")], items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_words int, items string"),
        spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, record string"),
    )


def test_equals_brute_force_in_one_block_and_in_many(spark):
    for seed, words, limits in ((1, 10, {}), (2, 4, {}), (3, 10, {"max_records": 40}), (4, 3, {"max_bytes": 900})):
        docs, items = sample(seed)
        assert got(decontam.find(*frames(spark, docs, items), words=words, **limits)) == plain(docs, items, words)


def test_lower_containment_equals_brute_force(spark):
    docs, items = sample(5)

    def shingles(v):
        s = min(decontam.SHINGLE, len(v))
        return {tuple(v[i : i + s]) for i in range(len(v) - s + 1)}

    want = []
    for doc_id, text in docs:
        w, hit, names = words_of(text), set(), set()
        for item_id, item in items:
            v = words_of(item)
            m = min(len(v), 10)
            for r in {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else ():
                wanted, s = shingles(r), min(decontam.SHINGLE, m)
                for i in range(len(w) - m + 1):
                    if len(wanted & {tuple(w[j : j + s]) for j in range(i, i + m - s + 1)}) >= 0.6 * len(wanted) - 1e-9:
                        hit |= set(range(i, i + m))
                        names |= {str(item_id)} if item_id is not None else set()
        want.append((doc_id, len(w), tuple(sorted(hit)), tuple(sorted(names))))
    assert got(decontam.find(*frames(spark, docs, items), containment=0.6)) == sorted(want, key=str)


def test_odd_documents_and_empty_tables(spark, odd_docs, no_docs):
    docs, items = sample(6)
    d, b = frames(spark, docs, items)
    assert decontam.find(no_docs, b).count() == 0
    clean = decontam.find(d, b.where("false")).collect()
    assert len(clean) == len(docs) and not any(r["spans"] or r["items"] for r in clean)
    item = spark.createDataFrame([(1, "word " * 12), (2, "over the stones into the quiet valley below the hills"), (3, "END")], "item_id long, text string")
    out = {(r["doc_id"], r["n_words"]): r for r in decontam.find(odd_docs, item).collect()}
    assert out[6, 30_001]["items"] == ["1", "3"] and out[6, 30_001]["spans"][0].asDict() == {"start": 0, "end": 30_001}
    assert out[1, 18]["items"] == ["2"] == out[8, 18]["items"] and out[3, 0]["items"] == [] == out[2, 0]["items"]
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect() if r["doc_id"] != 6]
    assert got(decontam.find(odd_docs.where("doc_id is null or doc_id <> 6"), item)) == plain(rows, [(1, "word " * 12), (2, "over the stones into the quiet valley below the hills"), (3, "END")])
