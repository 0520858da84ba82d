"""Personal data: patterns, secrets by their own information, and information-theoretic sanitisation of what gives them away.

DataFrame operations only. Protected entities are of two kinds. One is the patterns' matches. The other is runs of letters and
digits that by the corpus's own statistics no document would hold by chance: the corpus tells how often a run of letters is followed at once by a digit and
a run of digits by a letter, so a run's changes between the two have a probability; its information is -ln of that,
and where this reaches ln of the number of all runs of the corpus, less than one such run is to be expected in it. Keys, tokens and
hashes are of this kind; `mp3` or `covid19` are not.

The corpus tells how strongly a term in an entity's text reveals it: with document counts, PMI(e; t) = ln(n(e,t) N / (n(e) n(t))) is compared with the
entity's own information IC(e) = ln(N / n(e)). A term whose PMI is above 0 and reaches `share` of IC discloses the entity,
however few texts hold the two and however far apart they stand, and all its places in texts that hold the entity are spans too.
A term counts wherever it stands in a text, within the entities too; only places outside them become spans. All counts are of rows.
Sanitised texts generalise the patterns' matches to their kind and remove the other spans.

Places are running sums over the rows of exploded matches and overlaps are found in sorted sweeps, so a text's cost is linear in its matches. Entities that stand in
the very same texts are judged once, by one of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty

SHARE, LEAST_LETTERS = 0.9, 3
KINDS = ("email", "ip", "card", "phone", "term")
BASE = KINDS[:4]
#: The contract's patterns. A match can begin only where a run begins or the last match ended, and runs are
#: possessive: the same matches, without trying every place of a long run and without a deep stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of these has no valid match of the kind.
HINTS = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": "[0-9](?:[\\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
STEPS = "array<struct<kind:int,i:int,gap:int,value:string>>"
TERM = rf"\p{{L}}{{{LEAST_LETTERS},}}"
RUN, TO_DIGIT, TO_LETTER = "[A-Za-z0-9]++", "[A-Za-z][0-9]", "[0-9][A-Za-z]"
#: A text without a match of this has no run that changes twice between letters and digits, as entities must.
MIXED = "[A-Za-z][0-9]++[A-Za-z]|[0-9][A-Za-z]++[0-9]"


def _luhn(digits: str) -> str:
    digit = f"cast(substring({digits}, i, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + IF((length({digits}) - i) % 2 = 0, {digit}, IF({digit} > 4, 2 * {digit} - 9, 2 * {digit}))) % 10 = 0"


def _valid(kind: str, value: str) -> str:
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return {
        "email": "true",
        "ip": f"{value} rlike '^{octet}(?:[.]{octet}){{3}}$'",
        "card": f"length({digits}) between 16 and 19 and {_luhn(digits)}",
        "phone": f"length({digits}) between 8 and 15",
    }[kind]


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def _gaps(pattern: str) -> str:
    """SQL of the matches of a pattern in `text`, each with the length of what lies before it (value, gap); the last one is what follows all of them (value null)."""
    return f"zip_with(transform(regexp_extract_all(text, {_quoted(pattern)}, 0), x -> x), transform(split(text, {_quoted(pattern)}, -1), x -> length(x)), (h, g) -> struct(h as value, g as gap))"


def _steps() -> Column:
    """Array of the matches of all kinds of `text`, not yet tested."""
    none = f"cast(array() as {STEPS})"
    kinds = (
        f"IF(text rlike {_quoted(HINTS[k])}, filter(transform({_gaps(PATTERNS[k])}, (x, i) -> struct({n} as kind, i, x.gap as gap, x.value as value)), x -> x.value is not null), {none})"
        for n, k in enumerate(BASE)
    )
    return F.expr(f"concat({', '.join(kinds)})")


def _ends(by: list[str]) -> Column:
    """Where a match ends: a running sum in the order of matches."""
    return F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")


def _places(texts: DataFrame, pattern: str) -> DataFrame:
    """tkey, value, start, end of every match of a pattern in texts (tkey, text)."""
    rows = texts.select("tkey", F.posexplode_outer(F.expr(_gaps(pattern))).alias("i", "x")).select("tkey", "i", "x.gap", "x.value").filter("value is not null")
    return rows.withColumn("end", _ends(["tkey"])).select("tkey", "value", (F.col("end") - F.length("value")).alias("start"), "end")


def _words() -> Column:
    """The different terms of `text`, in lower case."""
    return F.expr(f"array_distinct(transform(regexp_extract_all(text, {_quoted(TERM)}, 0), x -> lower(x)))")


def _clear(spots: DataFrame, marks: DataFrame) -> DataFrame:
    """The spots (tkey, value, start, end) that overlap no mark (tkey, start, end), by two sorted sweeps over each text."""
    both = spots.select("tkey", "value", "start", "end", F.lit(0).alias("mark")).unionByName(marks.select("tkey", F.lit(None).cast("string").alias("value"), "start", "end", F.lit(1).alias("mark")))
    so_far = lambda *order: Window.partitionBy("tkey").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last_end = F.max(F.when(F.col("mark") == 1, F.col("end"))).over(so_far("start", F.desc("mark")))
    next_start = F.min(F.when(F.col("mark") == 1, F.col("start"))).over(so_far(F.desc("start"), F.desc("mark")))
    swept = both.withColumn("last_end", last_end).withColumn("next_start", next_start).filter("mark = 0")
    return swept.filter("coalesce(last_end, 0) <= start and coalesce(next_start, end) >= end").select("tkey", "value", "start", "end")


def _protected(texts: DataFrame, work: Workspace, information: Column) -> DataFrame:
    """tkey, kind (number of the pattern, or 4 for a secret), start, end, value of all entities of texts."""
    rows = texts.select("tkey", F.explode_outer("steps").alias("x")).select("tkey", "x.*").filter("value is not null")
    valid = " or ".join(f"(kind = {n} and {_valid(k, 'value')})" for n, k in enumerate(BASE))
    base = rows.withColumn("end", _ends(["tkey", "kind"])).filter(valid).select("tkey", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value")
    base = work.write(base, "base")
    runs = _places(texts.filter(F.col("text").rlike(MIXED)), RUN).filter(F.col("value").rlike(MIXED)).filter(information)
    secrets = _clear(runs, base).select("tkey", F.lit(len(BASE)).alias("kind"), "start", "end", "value")
    return work.write(base.unionByName(secrets), "protected")


def find_personal_data(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """Every row of docs with its spans: doc_id, tkey, base and terms (arrays of kind, start, end, value; code points, end exclusive).

    base holds the patterns' spans by kind in the order of KINDS, then start; terms, by start, the secrets that overlap none of
    them and the disclosing terms that overlap neither. Null and empty texts have none. Rows that agree in text get the same
    result; tkey (128 bits of the text) tells a doc_id's different texts apart. A null doc_id stays null. Counts are over all rows. Other columns are not read; no rows give no rows.
    """
    work = Workspace(docs.sparkSession, "pii")
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    some = lambda pattern: F.when(F.col("text").rlike("[0-9]"), F.regexp_count("text", F.lit(pattern))).otherwise(0)
    counts = [F.regexp_count("text", F.lit("[A-Za-z]++")).alias("letters"), some("[0-9]++").alias("digits"), some(TO_DIGIT).alias("to_digit"), some(TO_LETTER).alias("to_letter")]
    found = rows.select("doc_id", F.md5("text").alias("tkey"), "text", _steps().alias("steps"), *counts)
    asked = (F.size("steps") > 0) | F.col("text").rlike(MIXED)
    found = work.write(found.withColumn("text", F.when(asked, F.col("text"))), "found")
    names = ["letters", "digits", "to_digit", "to_letter"]
    n = found.agg(F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).first()
    total = F.lit(float(max(1, n["rows"])))
    changes = lambda pattern, hits, of: F.regexp_count("value", F.lit(pattern)) * math.log((n[of] + 2) / (n[hits] + 1))
    surprise = changes(TO_DIGIT, "to_digit", "letters") + changes(TO_LETTER, "to_letter", "digits")
    # Copies of a text hold the same: they are looked at once, and count as many rows.
    texts = found.filter("text is not null").groupBy("tkey").agg(F.first("text").alias("text"), F.first("steps").alias("steps"), F.count(F.lit(1)).alias("rows"))
    texts = work.write(texts, "texts")
    found = work.write(found.select("doc_id", "tkey"), "rows")
    work.drop("found")
    marks = _protected(texts, work, surprise >= math.log(max(2, n["letters"] + n["digits"])))
    name = F.concat_ws(":", "kind", F.when(F.col("kind").isin(2, 3), F.regexp_replace("value", "[^0-9]", "")).otherwise(F.lower("value")))
    held = marks.select("tkey", name.alias("entity")).distinct().join(texts.select("tkey", "rows"), "tkey")
    # Entities of the very same texts fare alike: the first of them stands for all.
    places = [F.bit_xor(F.xxhash64(F.lit(i), F.col("tkey"))).alias(f"x{i}") for i in range(2)]
    known = held.groupBy("entity").agg(F.sum("rows").alias("n_entity"), F.count(F.lit(1)).alias("texts"), *places)
    first = known.groupBy("n_entity", "texts", "x0", "x1").agg(F.min("entity").alias("entity"))
    # n_both is n_entity at most: a term in more texts than `most` cannot reach the share. No pair is lost by that, and few are left.
    most = F.pow(total, F.lit(1 - share)) * F.pow(F.col("n_entity"), F.lit(share)) * (1 + 1e-9)
    held = work.write(held.join(first.select("entity", "n_entity", F.col("texts").alias("n_texts"), most.alias("most")), "entity"), "held")
    seen = rows.select(F.explode_outer(_words()).alias("term")).filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    own = texts.join(held.groupBy("tkey").agg(F.max("most").alias("bound")), "tkey").select("tkey", "bound", F.explode_outer(_words()).alias("term")).filter("term is not null")
    own = work.write(own.join(seen, "term").filter("n_term <= bound").select("tkey", "term", "n_term"), "terms")
    pairs = held.join(own, "tkey").filter("n_term <= most").select("tkey", "rows", "entity", "n_entity", "n_texts", "term", "n_term")
    information = F.log(total / F.col("n_entity"))
    gain = F.log(F.col("n_both") * total / (F.col("n_entity") * F.col("n_term")))
    strong = (gain > 0) & (gain >= F.lit(share) * information)
    # Where an entity stands in one text only, so does every pair that it is in.
    alone = pairs.filter("n_texts = 1").withColumn("n_both", F.col("rows")).filter(strong).select("tkey", "term")
    several = work.write(pairs.filter("n_texts > 1"), "pairs")
    telling = several.groupBy("entity", "term", "n_entity", "n_term").agg(F.sum("rows").alias("n_both")).filter(strong)
    more = several.join(telling.select("entity", "term"), ["entity", "term"], "left_semi").select("tkey", "term")
    told = work.write(alone.union(more).distinct(), "told")
    work.drop("held", "terms", "pairs")
    spots = _told(texts, told)
    terms = _clear(spots, marks).unionByName(marks.filter(F.col("kind") == len(BASE)).select("tkey", "value", "start", "end"))
    spans = terms.withColumn("kind", F.lit(len(BASE))).unionByName(marks.filter(F.col("kind") < len(BASE)))
    listed = lambda when: F.transform(
        F.sort_array(F.collect_list(F.when(when, F.struct("kind", "start", "end", "value")))),
        lambda x: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")),
    )
    spans = spans.groupBy("tkey").agg(listed(F.col("kind") < len(BASE)).alias("base"), listed(F.col("kind") == len(BASE)).alias("terms"))
    spans = work.write(spans, "spans")
    work.drop("texts", "told", "base", "protected")
    none = F.expr(f"cast(array() as {SPANS})")
    return found.select("doc_id", "tkey").join(spans, "tkey", "left").select("doc_id", "tkey", F.coalesce("base", none).alias("base"), F.coalesce("terms", none).alias("terms"))


def _told(texts: DataFrame, told: DataFrame) -> DataFrame:
    """tkey, value, start, end of all places of the terms told (tkey, term)."""
    places = _places(texts.join(told.select("tkey").distinct(), "tkey", "left_semi"), TERM).withColumn("term", F.lower("value"))
    return places.join(told, ["tkey", "term"], "left_semi").select("tkey", "value", "start", "end")


def sanitise(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """docs with sanitised texts, in the columns of docs: a pattern's match gives way to `[kind]`, a secret or disclosing term to nothing.

    Spans that overlap are one, named by the first of them. Null texts stay null, empty ones empty; rows that repeat are treated alike, and no row goes.
    Names of docs may be any; no rows give no rows.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: names[docs.columns.index(c)] for c in ("doc_id", "text")}
    found = find_personal_data(docs.select("doc_id", "text"), share).groupBy("tkey").agg(F.first(F.concat("base", "terms")).alias("all")).filter(F.size("all") > 0)
    # Runs of overlapping spans: a span begins one where it starts at or after the end of all before it.
    span = found.select("tkey", F.explode("all").alias("s")).select("tkey", "s.kind", "s.start", "s.end")
    order = Window.partitionBy("tkey").orderBy("start", "end", "kind")
    span = span.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    span = span.withColumn("run", F.sum(F.when(F.coalesce("reach", F.lit(0)) <= F.col("start"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = span.groupBy("tkey", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))
    before = F.coalesce(F.lag("end").over(Window.partitionBy("tkey").orderBy("run")), F.lit(0))
    runs = runs.withColumn("before", before).groupBy("tkey").agg(F.sort_array(F.collect_list(F.struct("start", "before", "end", "kind"))).alias("runs"))
    rows = docs.toDF(*names).withColumn("tkey", F.md5(text_or_empty(at["text"])))
    text = F.expr(
        f"array_join(concat(transform(runs, r -> concat(array_join(slice(chars, r.before + 1, r.start - r.before), ''), IF(r.kind = '{KINDS[-1]}', '', concat('[', r.kind, ']')))),"
        " array(array_join(slice(chars, element_at(runs, -1).end + 1, size(chars)), ''))), '')"
    )
    joined = rows.join(runs, "tkey", "left").withColumn("chars", F.when(F.col("runs").isNotNull(), F.split(at["text"], "")))
    return joined.select(*((F.when(F.col("runs").isNull(), F.col(n)).otherwise(text) if n == at["text"] else F.col(n)).alias(c) for n, c in zip(names, docs.columns)))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of find_personal_data(), n_term (the method's own spans) and n_spans (all spans)."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    both = F.concat("base", "terms")
    return found.select(
        "doc_id", *(count(k) for k in BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(both).alias("spans"),
        F.size("terms").cast("long").alias("n_term"), F.size(both).cast("long").alias("n_spans"),
    )
