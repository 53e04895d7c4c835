import random
import re
import time

import pytest

from mnemara.llm import licenses


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.95])
def test_pruning_loses_nothing(threshold):
    """Any subset of a template's bigrams, with foreign ones beside it, that reaches the threshold has an admitted size and a key word."""
    rng = random.Random(1)
    for _, text in licenses.TEMPLATES:
        grams = licenses.template_bigrams(text)
        low, high = licenses.size_bounds(len(grams), threshold)
        keys = set(licenses.key_words(grams, threshold))
        for _ in range(60):
            kept = rng.sample(grams, rng.randint(1, len(grams)))
            size = len(kept) + rng.randint(0, len(grams))
            if 2 * len(kept) / (size + len(grams)) >= threshold:
                assert low <= size <= high and any(keys & set(g.split()) for g in kept)


def test_matches(spark, odd_docs, no_docs):
    apache = licenses.TEMPLATES[1][1]
    rows = [
        (1, "Some prose.\nReleased under the MIT License.\nMore prose about rivers."),
        (2, "Released   under the mit LICENSE"),
        (3, f"Code.\n\n{apache}\n\nMore."),
        (4, apache.replace("limitations", "bounds").replace("obtain", "get")),
        (5, "The license of the mill was released"),
        (6, None),
        (7, ""),
        (1, "Some prose.\nReleased under the MIT License.\nMore prose about rivers."),
        (8, "This work is licensed under the GNU General Public License, version 3. " * 3),
    ]
    out = {(r["doc_id"], r["license"]): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(out) == {(1, "MIT"), (2, "MIT"), (3, "Apache-2.0"), (4, "Apache-2.0"), (8, "GPL-3.0"), *[k for k in out if k[0] == 8]}
    assert out[1, "MIT"]["dice"] == 1 == out[3, "Apache-2.0"]["dice"] and 0.8 <= out[4, "Apache-2.0"]["dice"] < 1 and out[1, "MIT"]["n_units"] == 1
    assert licenses.scan(odd_docs).count() == 0 and licenses.scan(no_docs).count() == 0


def test_notices_of_several_paragraphs_and_wrapped_sentences(spark):
    text = {n: t for n, t in licenses.TEMPLATES if len(t) > 300}
    prose = "The river ran past the old mill.\nIt was a quiet valley below the hills"

    def inside(notice):
        return f"{prose}\n\n{notice}\n\n{prose}"

    mit = text["MIT"].replace(" The above copyright", "\n\nThe above copyright").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    bsd = text["BSD-3-Clause"].replace(": Redis", ":\n\nRedis").replace(". Redis", ".\n\nRedis").replace(". Neither", ".\n\nNeither")
    apache = text["Apache-2.0"].replace("License. You", "License.\nYou").replace("2.0 Unless", "2.0\n\nUnless").replace(". See", ".\n\nSee")
    gpl = text["GPL-3.0"].replace(". This", ".\n\nThis").replace(". See", ".\n\nSee").replace("that it will", "that\nit will").replace("version. ", "version.\n\n")
    disclaimer = "\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY WARRANTIES ARE DISCLAIMED. " * 2
    rows = [(1, inside(mit)), (2, inside(bsd + disclaimer)), (3, inside(apache)), (4, inside(gpl)), (5, f"{prose}. Released under\nthe MIT License. {prose}"), (6, inside(prose + " license"))]
    out = {(r["doc_id"], r["license"]): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, "MIT"), (2, "BSD-3-Clause"), (3, "Apache-2.0"), (4, "GPL-3.0"), (5, "MIT")} == set(out)
    assert out[1, "MIT"]["dice"] == 1 == out[2, "BSD-3-Clause"]["dice"] and all(r["n_units"] == 1 for r in out.values())


def plain_scan(rows, threshold=licenses.THRESHOLD):
    """Every unit and every run of consecutive pieces of every text against every template."""

    def words(text):
        return [w for w in re.split(r"[\W_]+", text.lower()) if w]

    def grams(ws):
        return {f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)}

    best, units = {}, {}
    for doc_id, text in rows:
        if text is None:
            continue
        sentences = re.sub(r"([.!?])\s+", "\\1\n", text).split("\n")
        parts = {" ".join(words(u)) for u in [text, *re.split(r"\n[ \t\r]*\n", text), *text.split("\n"), *sentences]}
        pieces = [w for w in map(words, sentences) if w]
        runs = [sum(pieces[i:j], []) for i in range(len(pieces)) for j in range(i + 2, len(pieces) + 1)]
        for name, template in licenses.TEMPLATES:
            t = grams(words(template))
            cap = 2 * (licenses.size_bounds(len(t), threshold)[1] + 1)
            for unit, is_run in [(u.split(), False) for u in parts] + [(r, True) for r in runs if len(r) <= cap]:
                g = grams(unit)
                d = 2 * len(g & t) / (len(g) + len(t))
                if g and d >= threshold:
                    best[doc_id, name] = max(d, best.get((doc_id, name), 0))
                    if not is_run:
                        units.setdefault((doc_id, name), set()).add(" ".join(unit))
    return {k: (round(d, 6), max(1, len(units.get(k, ())))) for k, d in best.items()}


def test_runs_and_units_equal_brute_force(spark):
    rng = random.Random(7)
    prose = "The river ran past the old mill under a license of the land by its source and to any person".split()
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(1, 4)):
            notice = rng.choice(licenses.TEMPLATES)[1].split()
            for at in range(len(notice)):  # lost and foreign words, line breaks, blank lines and sentence ends
                notice[at] = rng.choice(["", rng.choice(prose)]) if rng.random() < 0.04 else notice[at]
            text += [*rng.choices(prose, k=rng.randint(0, 25)), *(notice * rng.choice([1, 1, 2]))]
        rows.append((i, "".join(w + rng.choices([" ", "\n", "\n\n", ". ", "!\t"], [30, 3, 1, 2, 1])[0] for w in text)))
    out = {(r["doc_id"], r["license"]): (r["dice"], r["n_units"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_scan(rows)
    assert out == want and len(want) > 40
    assert any(d < 1 for d, _ in want.values()) and any(n > 1 for _, n in want.values())


def test_very_long_texts_cost_no_more_than_their_length(spark):
    mit = dict(licenses.TEMPLATES[::-1])["MIT"]
    long = ("the mill by the river. " * 40_000) + mit + "\n" + "Released under the MIT License.\n" * 2_000
    began = time.time()
    out = licenses.scan(spark.createDataFrame([(1, long), (1, long), (2, "by the source " * 200_000)], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["license"], r["dice"]) for r in out} == {(1, "MIT", 1.0)}
    assert time.time() - began < 60
