
import math
import re
from collections import Counter, defaultdict

import numpy as np
from brute import WORD, jaccard_components, personal

from cairnlake.llm import linededup, mix, ngramjoin, pii


LETTERS = re.compile(r"[^\W\d_]{3,}")


# ---- line dedup ---------------------------------------------------------------------------------------


def maximal_runs(docs, min_words):
    """docs: (doc_id, text), ids unique. All runs of lines, of any length, against all earlier ones that they don't overlap; no blank lines."""
    first, gone = {}, defaultdict(set)
    for d, t in sorted(docs):
        lines = [(i, s, len(WORD.findall(s))) for i, s in enumerate(t.split("\n")) if WORD.search(s)]
        for k in range(len(lines)):
            for j in range(k + 1, len(lines) + 1):
                if sum(n for _, _, n in lines[k:j]) >= min_words:
                    run = tuple(s for _, s, _ in lines[k:j])
                    at, last = first.setdefault(run, (d, lines[j - 1][0]))
                    if at != d or lines[k][0] > last:
                        gone[d].update(i for i, _, _ in lines[k:j])
    return {d: sorted(x) for d, x in gone.items()}


def removed(df, docs):
    """Blank lines within a window go with it; they are left out here."""
    text = {d: t.split("\n") for d, t in docs}
    got = {r["doc_id"]: [i for i in r["removed_lines"] if WORD.search(text[r["doc_id"]][i])] for r in df.collect()}
    return {d: x for d, x in got.items() if x}


def test_line_dedup_of_maximal_runs(spark):
    long, short = " ".join(f"l{i}" for i in range(60)), " ".join(f"s{i}" for i in range(30))
    docs = [(1, f"{long}\n{short}\nend one"), (2, f"head\n{long}\n{short}\nend two"), (3, f"{short}\n{long}\n{short}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert removed(linededup.dedup_lines(df, maximal=True), docs) == {2: [1, 2], 3: [1, 2]} == maximal_runs(docs, 50)
    rng = np.random.default_rng(7)
    docs = [(i, "\n".join(rng.choice(["a", "b b", "c c c", "d d d d d", "", " "], rng.integers(0, 14)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for least in (4, 7, 12):
        assert removed(linededup.dedup_lines(df, least, maximal=True), docs) == maximal_runs(docs, least)


# ---- personal data ------------------------------------------------------------------------------------


def terms(spark, docs):
    """docs: (doc_id, text) -> {doc_id: the terms that are spans}, at the query's parameters."""
    text = dict(docs)
    found = pii.find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    return {r["doc_id"]: [text[r["doc_id"]][s["start"] : s["end"]] for s in r["terms"]] for r in found}


COMMON = [(100 + i, "common words are written from here about that matter") for i in range(300)]


def test_terms_of_rare_entities(spark):
    docs = [*COMMON, (1, "Zebulon are written from zeb@x.org about common matter"), (2, "common words Quillon are here +49 30 1234567"), (3, "here Quillon written +49 (30) 1234567")]
    got = terms(spark, docs)
    assert got[1] == ["Zebulon"] and got[2] == got[3] == ["Quillon"] and not got[100]


def test_terms_of_copies(spark):
    copy = "common words Zebulon are written from zeb@x.org about"
    docs = [*COMMON, (1, "Zebulon are common from zeb@x.org words"), (2, "words here Zebulon from zeb@x.org about"), *((1000 + i, copy) for i in range(40))]
    got = terms(spark, docs)
    assert all(got[d] == ["Zebulon"] for d in (1, 2, *range(1000, 1040))) and not got[100]


def test_terms_far_from_their_entity(spark):
    far = "Zebulon " + "common words are written from here about that matter " * 9 + "zeb@x.org " + "here about that common matter " * 9 + "to ZEBULON, Zebulon"
    got = terms(spark, [*COMMON, (1, far), (2, "Zebulon zeb@x.org common")])
    assert got[1] == ["Zebulon", "ZEBULON", "Zebulon"] and got[2] == ["Zebulon"] and not got[100]


def test_terms_against_plain_python(spark):
    rng = np.random.default_rng(3)
    words, mails = ["about", "here", *(f"w{chr(97 + i)}x" for i in range(20)), "Ünïö", "x1abc2"], [f"m{chr(97 + i)}m@xyz.org" for i in range(12)]
    docs = [(i, " ".join([*rng.choice(words, rng.integers(1, 9)), *rng.choice(mails, rng.integers(0, 3)), *rng.choice(words, 2)])) for i in range(120)]
    docs += [(900 + i, f"rare{chr(97 + i)} about m{chr(97 + i)}r@xyz.org wax rare{chr(97 + i)}") for i in range(8)]
    docs += docs[:30] + [(i + 500, t) for i, t in docs[:20]]
    known = [({t[a:b].lower() for _, a, b in personal(t)}, {w.lower() for w in LETTERS.findall(t)}) for _, t in docs]
    n_entity, n_term = Counter(e for es, _ in known for e in es), Counter(w for _, ws in known for w in ws)
    both = Counter((e, w) for es, ws in known for e in es for w in ws)
    for share in (0.9, 0.4):
        gain = {k: math.log(n * len(docs) / (n_entity[k[0]] * n_term[k[1]])) for k, n in both.items()}
        telling = {k for k, g in gain.items() if g > 0 and g >= share * math.log(len(docs) / n_entity[k[0]])}
        want = []
        for (d, t), (es, _) in zip(docs, known):
            base, spots = personal(t), [(m.start(), m.end(), m[0].lower()) for m in LETTERS.finditer(t)]
            want.append((d, [(a, b) for a, b, w in spots if any((e, w) in telling for e in es) and not any(x < b and a < y for _, x, y in base)]))
        got = pii.find_personal_data(spark.createDataFrame(docs, "doc_id long, text string"), share=share).collect()
        assert any(x for _, x in want) and sorted((r["doc_id"], [(s["start"], s["end"]) for s in r["terms"]]) for r in got) == sorted(want)


# ---- mixing -------------------------------------------------------------------------------------------


def test_mixed_documents_of_repeated_ids(spark):
    text = lambda i, n: " ".join(f"d{i}w{k}" for k in range(n))
    docs = [(None if i % 3 else 7, text(i, 1 + 5 * i % 23), "ab"[i % 2]) for i in range(40)]
    docs += [(i % 5, text(100 + i, 3 + i), "c") for i in range(20)] + [(3, text(999, 50), "c")] * 4 + [(None, "", "a"), (None, None, "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    want = Counter()
    for r in mix.mix(df).collect():
        want[r["doc_id"], r["source"]] += r["taken"]
    got, kept = Counter(), mix.mixed_documents(df).collect()
    for r in kept:
        assert any(d == r["doc_id"] and s == r["source"] and (t or "").startswith(r["text"] or "") for d, t, s in docs)
        got[r["doc_id"], r["source"]] += len(WORD.findall(r["text"] or ""))
    assert +got == +want and sum(not r["text"] for r in kept) == 2


# ---- n-gram join --------------------------------------------------------------------------------------


def test_ngram_join_of_an_id_with_two_texts(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "FREQUENT", 10**9)
    run = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    p, q = run("p", 44), run("q", 44)
    # All share q with 1, the leader. 2 is near it by one text; its other text is near 3 alone, which is far from the leader.
    told = [(1, f"{q} {p}"), (2, f"{q} {p} x"), (2, f"{q} y"), (3, f"{q} z")]
    rest = [(10 + i, f"{q} {run(f'r{i}x', 60)}") for i in range(250)]
    for docs in ([*told, *rest], [(4 - d if d < 4 else d, t) for d, t in told] + rest, [*told[:2], (2, f"{q} {run('y', 4)}"), (1, f"{q} z"), (3, f"{q} {run('z', 4)}"), *rest]):
        got = sorted(map(tuple, ngramjoin.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
        assert got == jaccard_components(docs)
