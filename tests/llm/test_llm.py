"""The corpus operators against plain Python, on invented cases and on the small tables."""

import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import EMAIL, WORD, digest, jaccard_components, judge, lower_bound, mix_targets, personal, repeated_lines, sha, top_k
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairnlake.llm import exactdedup, linededup, mix, ngramjoin, packing, pii, quality, queries, tokencount, topk, transducer, urlfilter

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rest string, size int, key string, line int, base string, words int, path string, n int, tkey long, b string, m int, row long"
EXTRA = [None] * 12
LONG = " ".join(f"w{i % 997}" for i in range(60_000))
ODD = [
    (1, "one two three four five six seven", "en", "b"), (1, "one two three four five six seven", "en", "b"), (2, None, None, "a"), (3, "", "en", "a"),
    (4, " \n\t ", "en", None), (5, LONG, "en", "b"), (6, LONG + " tail", "en", "b"), (7, "One TWO three four five six seven", "en", ""), (None, "no id at all", "en", "a"),
    (8, "Ünïcödé ﬁ ΣΑΣ İ 'S <|endoftext|>x\u00a0y", "de", "c"), (9, "\n\n", "en", "c"), (10, "x", "en", "c"), (11, "x", "fr", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, None, *EXTRA[:12]) for r in ODD], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars", "rest", "size", "key", "line", "base", "words", "path", "n", "tkey", "b", "m", "row")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows(df):
    return [tuple(r) for r in df.collect()]


def by_none(x):
    return tuple((v is None, v if v is not None else 0) for v in x)


# ---- exact dedup --------------------------------------------------------------------------------------


def exact_brute(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[t or ""].append(d)
    return sorted(((d, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), sha(t)) for d, t in docs), key=by_none)


def test_exact_groups(odd, none, documents):
    assert sorted(rows(exactdedup.exact_groups(odd, 8, 8, 64 * 1024)), key=by_none) == exact_brute([r[:2] for r in ODD])
    texts = rows(documents.select("doc_id", "text"))
    assert sorted(rows(exactdedup.exact_groups(documents)), key=by_none) == exact_brute(texts)
    assert rows(exactdedup.exact_groups(none)) == []


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab\u00e9", max_size=9), max_size=40))
def test_exact_groups_of_short_texts(spark, texts):
    docs = list(enumerate(texts))
    got = exactdedup.exact_groups(spark.createDataFrame(docs, "doc_id long, text string"), 2, 2, 4)
    assert sorted(rows(got), key=by_none) == exact_brute(docs)


def test_exact_dedup_keeps_one_of_each(odd):
    kept = rows(exactdedup.exact_dedup(odd).select("doc_id", "text"))
    assert Counter(t or "" for _, t in kept) == Counter({t or "" for _, t, *_ in ODD})
    assert (11, "x") in kept and (10, "x") not in kept
    assert exactdedup.exact_dedup(odd).columns == odd.columns


# ---- mixing -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_mix(table, request):
    docs = request.getfixturevalue(table)
    got = [r.asDict() for r in mix.mix(docs).collect()]
    texts = rows(docs.select("doc_id", "text", "source"))
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for _, t, s in texts:
        sizes[s] += size(t)
    want = mix_targets(sizes)
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == sorted((d or 0, size(t)) for d, t, _ in texts)
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(want[s] + 1e-6) for s in sizes)
    assert sorted(rows(mix.mix(docs.repartition(5))), key=str) == sorted((tuple(r.values()) for r in got), key=str)


def test_mixed_documents(odd, none, documents):
    assert rows(mix.mix(none)) == [] and mix.mixed_documents(odd).columns == odd.columns
    out = mix.mixed_documents(documents).select("doc_id", "text", "source", "n_chars").collect()
    want = Counter()
    for r in mix.mix(documents).collect():
        want[r["doc_id"]] += r["taken"]
    got = Counter()
    whole = dict(rows(documents.select("doc_id", "text")))
    for r in out:
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert whole[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert +got == +want


# ---- top-k --------------------------------------------------------------------------------------------


def floored(v):
    return [np.floor(256 * float(x)) for x in v]


def test_top_k(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in np.round(rng.normal(size=8), 2)]) for i in range(300)]
    data += [(300 + i, [0.5] * 8) for i in range(40)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, []), (None, [1.0] * 8), (405, [1.0, 2.0]), (7, [9.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("d", F.lit(1)).withColumn("qb", F.lit("x"))
    asked = df.filter("vec_id % 20 = 0 or vec_id = 404")
    got = sorted(rows(topk.exact_top_k(df, asked, pivots=6, query_block=5, row_block=64).select("query_id", "rank", "vec_id", "score")))
    good = [(i, floored(v)) for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    assert got == sorted(top_k(good, [(i, v) for i, v in good if i % 20 == 0 or i == 404]))
    assert rows(topk.exact_top_k(df.limit(0), asked)) == [] and rows(topk.exact_top_k(df, asked.limit(0))) == []


def test_top_k_of_few_and_large(spark):
    df = spark.createDataFrame([(1, [1e12, 1.0]), (2, [1e12, -1.0]), (3, [-1e12, 0.0])], "vec_id long, embedding array<double>")
    got = rows(topk.exact_top_k(df, df).select("query_id", "rank", "vec_id", "score"))
    assert len(got) == 6 and (3, 1, 1, -(2**63)) in got


# ---- url filters --------------------------------------------------------------------------------------


URLS = [
    "http://Example.ORG/es/x", "https://a.example.org/en/12?q", "x://example.org", "http://org/", "http://notexample.org/es/", "a.example.org/es/", None, "", "://com/de/#", "http://u.com/de/a",
    "http://com/fr/b?://x", "http://b.com/f", "ftp://example.org:80/es/", "http://example.org?x/es/", "http://." + "a." * 300 + "org/x", "http://example.org/es/" + "p" * 5000, "h://ü.org/é", "h://com\n/de/",
]


@pytest.mark.parametrize("rate", [2**-10, 0.5])
def test_urls(spark, rate):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(0, URLS[0], "h")], "page_id long, url string, host string").withColumn("key", F.lit(1))
    rules = [*urlfilter.RULES, ("block", "net/"), ("allow", "net/")]
    got = sorted(rows(urlfilter.judge_urls(pages, rules, first_rate=rate)), key=str)
    want = [(i, *judge(u, [r for r in rules if r != ("allow", "net/")])) for i, u in [*enumerate(URLS), (0, URLS[0])]]
    assert got == sorted(want, key=str)
    assert rows(urlfilter.judge_urls(pages.limit(0))) == []


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    listed = [str(i) for i in range(0, 3000, 7)] + ["absent"]
    cascade = urlfilter.Cascade(listed, universe, 3, first_rate=0.4)
    assert len(cascade.levels) > 2
    got = {r[0] for r in universe.filter(cascade.lists(F.col("key"))).collect()}
    assert got == set(listed) - {"absent"}
    assert universe.filter(urlfilter.Cascade([], universe).lists(F.col("key"))).isEmpty()


# ---- packing ------------------------------------------------------------------------------------------


def pieces_brute(docs, room=4096):
    t, out = Tokenizer.from_file(TOKENIZER), []
    for d, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out += [(d, k, i, len(p := ids[i : i + room]), zlib.crc32(p.tobytes())) for k, i in enumerate(range(0, len(ids), room))]
    return out


@pytest.mark.parametrize("table", ["odd", "documents"])
@pytest.mark.parametrize("group", [100_000, 40])
def test_packing(table, group, request):
    docs = request.getfixturevalue(table)
    got = rows(packing.pack_documents(docs, TOKENIZER, group_pieces=group))
    assert sorted((r[:5] for r in got), key=by_none) == sorted(pieces_brute(rows(docs.select("doc_id", "text"))), key=by_none)
    places = defaultdict(list)
    for _, _, _, length, _, sequence, offset in got:
        places[sequence].append((offset, length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    if group == 100_000:
        assert len(places) <= 1.01 * lower_bound([r[3] for r in got]) + 1


def test_packing_of_nothing(none):
    assert rows(packing.pack_documents(none, TOKENIZER)) == []


def test_best_two_fit():
    bins = packing.best_two_fit([6, 5, 4, 3, 3], 10)
    assert sorted(i for b in bins for i in b) == [0, 1, 2, 3, 4] and len(bins) == 3
    lengths = [55, 40, 23, 22]  # greedy fills 55 + 40; 23 + 22 in place of 40 fill exactly
    assert sorted(map(sorted, packing.best_two_fit(lengths, 100))) == [[0, 2, 3], [1]]


# ---- quality ------------------------------------------------------------------------------------------


def test_quality(spark, documents, none, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.score_documents(documents, labels).collect()}
    assert len(got) == documents.count()
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    kept = quality.keep_good(documents, labels)
    assert kept.columns == documents.columns and {r[0] for r in kept.select("doc_id").collect()} == {d for d, r in got.items() if r["predicted"]}
    assert rows(quality.score_documents(none, labels)) == [] and rows(quality.keep_good(none, labels)) == []


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        pytest.skip("no table with enough labels")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").select("predicted", "quality").collect()
    assert sum(p == q for p, q in scored) / len(scored) > 0.9


def test_quality_of_odd_rows(spark, odd):
    one_kind = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = rows(quality.score_documents(odd, one_kind))
    assert len(got) == len(ODD) and all(r[2] == 0.5 and r[3] == 1 for r in got)
    both = spark.createDataFrame([(i, int(i not in (5, 6)), 0) for i in range(12)] + [(5, 0, 1)], "doc_id long, quality int, toxic int")
    assert len(rows(quality.score_documents(odd, both))) == len(ODD)


# ---- line dedup ---------------------------------------------------------------------------------------


def lines_of(df):
    return {r["doc_id"]: list(r["removed_lines"]) for r in df.collect() if r["removed_lines"]}


def test_line_dedup(documents, none):
    docs = rows(documents.select("doc_id", "text"))
    clean = linededup.dedup_lines(documents)
    want = repeated_lines(docs)
    assert want and lines_of(clean) == want
    for r in clean.collect():
        lines = dict(docs)[r["doc_id"]].split("\n")
        assert r["text"] == "\n".join(s for i, s in enumerate(lines) if i not in set(want.get(r["doc_id"], []))) and r["n_lines"] == len(lines)
    assert rows(linededup.dedup_lines(none)) == []


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a", "b b", "c c c", "", "  "]), max_size=10), max_size=8))
def test_line_dedup_of_small_runs(spark, texts):
    docs = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=4)
    assert lines_of(got) == repeated_lines(docs, 4)


def test_line_dedup_of_odd_rows(odd):
    clean = linededup.dedup_lines(odd)
    assert clean.columns == [*odd.columns, "n_lines", "removed_lines"] and clean.count() == len(ODD)
    assert [r["removed_lines"] for r in clean.filter("doc_id = 1").collect()] == [[], []]


# ---- token counts -------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_token_counts(odd, documents, none, chunk):
    t = Tokenizer.from_file(TOKENIZER)
    for df in (odd, documents) if chunk > 100 else (odd,):
        texts = rows(df.select("doc_id", "text"))
        want = [(d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for d, x in texts]
        assert sorted(rows(tokencount.count_tokens(df, TOKENIZER, chunk=chunk)), key=by_none) == sorted(want, key=by_none)
    assert rows(tokencount.count_tokens(none, TOKENIZER)) == []


_COUNTER, _LIBRARY = transducer.token_counter(TOKENIZER), Tokenizer.from_file(TOKENIZER)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab'stlveremd 1!<|startoftext>\u00e9\u0301\u03a3", max_size=60)), st.integers(1, 9))
def test_transducer(text, chunk):
    b = text.encode()
    maps = [tokencount.chunk_map(_COUNTER, b[i : i + chunk]) for i in range(0, len(b), chunk)] or [tokencount.chunk_map(_COUNTER, b"")]
    assert tokencount.compose_all(_COUNTER, maps) == len(_LIBRARY.encode(text, add_special_tokens=False).ids)


# ---- personal data ------------------------------------------------------------------------------------

PERSONAL = [
    "a@b.c._x@d.e mail me: jo.do+x@mail-1.example.org, or a@b@c.d", "1.2.3.4.5.6.7.8 and 256.1.1.1, 0001.2.3.004 1.2.3", "4539 1488 0343 6467 then 4539-1488-0343-6468; 453914880343646745391488034364674539",
    "+1 (017) 555-7713 +1234567 +12345678 ++1 2 3 4 5 6 7 8 +1234567890123456", "é😀 x@y.zz \u00a0 10.0.0.1", "9" * 3000, "a" * 3000 + "@", "a@b." + "c." * 900 + "d", "1." * 2000, "+" + "1 " * 2000, None, "",
]


def test_personal_data(spark, documents, none):
    docs = spark.createDataFrame(list(enumerate(PERSONAL)) + [(0, PERSONAL[0])], "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("s", F.lit(1))
    for df in (docs, documents):
        texts = dict(rows(df.select("doc_id", "text")))
        got = pii.digest(pii.find_personal_data(df)).collect()
        assert len(got) == df.count()
        for r in got:
            want = personal(texts[r["doc_id"]])
            assert r["base_sha256"] == sha(digest(want)), (r, want)
            assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in want) for k in ("email", "ip", "card", "phone")]
            assert r["spans"].startswith(digest(want)) and all(s.split(":")[0] == "term" for s in r["spans"][len(digest(want)) :].split(",") if s)
    assert rows(pii.find_personal_data(none)) == []


def test_disclosing_terms(spark):
    told = [(i, f"{i} common words Zebulon writes from zeb@x.org about common matter {i}") for i in range(5)]
    rest = [(10 + i, f"common words writes from about matter number {i}") for i in range(60)]
    docs = spark.createDataFrame([*told, *rest, (99, "zebulon without the address")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find_personal_data(docs, share=0.8)).collect()}
    for i, text in told:
        terms = [s.split(":") for s in got[i].split(",") if s.startswith("term")]
        assert [text[int(a) : int(b)] for _, a, b in terms] == ["Zebulon"]
    assert all(got[d] == "" for d, _ in rest) and got[99] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, share=0.8).collect()}
    assert not any(EMAIL.search(t) for t in clean.values()) and "Zebulon" not in clean[0] and "[email]" in clean[0] and clean[99] == "zebulon without the address"


# ---- n-gram join --------------------------------------------------------------------------------------


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_ngram_join(table, request):
    docs = request.getfixturevalue(table)
    got = sorted(rows(ngramjoin.jaccard_components(docs)), key=by_none)
    assert got == sorted(jaccard_components(rows(docs.select("doc_id", "text"))), key=by_none)


def family(rng, n, length, edits, first):
    base = [f"t{x}" for x in rng.integers(0, 50, length)]
    out = []
    for i in range(n):
        words = list(base)
        for p in rng.integers(0, length, rng.integers(0, edits + 1)):
            words[p] = f"e{rng.integers(0, 40)}"
        out.append((first + i, " ".join(words[: length - int(rng.integers(0, max(1, length // 10)))])))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_ngram_join_of_families(spark, seed, monkeypatch):
    monkeypatch.setattr(ngramjoin, "FREQUENT", 16 if seed else 10**9)
    rng = np.random.default_rng(seed)
    docs = [d for k in range(6) for d in family(rng, int(rng.integers(5, 60)), int(rng.integers(6, 80)), int(rng.integers(1, 6)), 1000 * k)]
    passage = " ".join(f"p{i}" for i in range(40))
    docs += [(9000 + i, passage + " " + " ".join(f"q{x}" for x in rng.integers(0, 500, rng.integers(5, 60)))) for i in range(50)]
    got = sorted(rows(ngramjoin.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))))
    assert got == jaccard_components(docs)


def test_ngram_join_keeps_one(odd, none):
    assert rows(ngramjoin.jaccard_components(none)) == []
    kept = ngramjoin.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(x[0] or 0 for x in rows(kept.select("doc_id"))) == [0, 1, 1, 2, 3, 4, 5, 8, 9, 10]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(0, 12), st.integers(0, 100))
def test_similar_sets_share_a_key(seed, n, changes, share):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    y = np.unique(np.concatenate([rng.permutation(x)[: max(0, len(x) - changes // 2)], rng.integers(0, 2**63, changes - changes // 2, dtype=np.uint64)]))
    both = len(np.intersect1d(x, y))
    if not len(y) or 100 * both < 75 * (len(x) + len(y) - both) or len(x) == len(y) == both:
        return
    often = np.sort(rng.permutation(np.union1d(x, y))[: (len(x) + len(y)) * share // 200])
    assert len(np.intersect1d(ngramjoin.index_keys(x, often)[0], ngramjoin.index_keys(y, often)[0]))


# ---- registration -------------------------------------------------------------------------------------


def test_registered():
    names = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)


def test_sql_agrees(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf_dir)
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(rows(df.select(*columns)), key=by_none) == sorted(want.fetchall(), key=by_none), name
