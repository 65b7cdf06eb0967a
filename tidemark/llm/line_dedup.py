"""Line dedup by winnowing over line hashes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import computed, discard, document_key, read, unclashed, written

#: Lines of a run that always counts as repeated, and words from which a run of fewer lines does.
MIN_RUN, MIN_WORDS = 3, 50
BLANK = " \t\r"


def winnowed(docs: DataFrame, min_run: int, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(fingerprint, k1, k2, place, near): the selected lines of each document, with the min_run - 1 lines before and after as (h, g, n), null beyond the ends.

    A line is selected if it is the leftmost smallest hash of a window: min_run consecutive lines, or fewer of min_words words or more together.
    Equal windows select the same line, so every repeated run holds a fingerprint of all its occurrences, while about half the lines are none.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != "")
    described = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("n")))
    hashed = computed(docs.select(*document_key(id_col, text_col), text_col), lines=described).select("k1", "k2", "lines").where(F.size("lines") > 0)
    pad = F.array_repeat(F.lit(None).cast("struct<h: bigint, g: bigint, n: int>"), min_run - 1)
    padded = computed(hashed, padded=F.concat(pad, "lines", pad)).drop("lines")
    near = F.transform(F.sequence(F.lit(1), F.size("padded") - 2 * (min_run - 1)), lambda i: F.slice("padded", i, 2 * min_run - 1))
    each = padded.select("k1", "k2", F.posexplode(near).alias("place", "near"))
    return each.where(F.expr(" or ".join(f"({selects(i, n, min_run, min_words)})" for i, n in around(min_run)))).select(F.col("near")[min_run - 1]["h"].alias("fingerprint"), "k1", "k2", "place", "near")


def around(min_run: int) -> list[tuple[int, int]]:
    """(first, lines) of the windows that hold the middle one of 2 * min_run - 1 lines."""
    return [(i, n) for n in range(1, min_run + 1) for i in range(min_run - n, min_run)]


def selects(first: int, n: int, min_run: int, min_words: int) -> str:
    """SQL: the window is whole and long enough, and its leftmost smallest hash is the middle line's."""
    middle, inside = min_run - 1, range(first, first + n)
    whole = [f"near[{i}] is not null" for i in (first, first + n - 1)]
    enough = [] if n == min_run else [" + ".join(f"near[{i}].n" for i in inside) + f" >= {min_words}"]
    least = [f"near[{i}].h {'>' if i < middle else '>='} near[{middle}].h" for i in inside if i != middle]
    return " and ".join(whole + enough + least)


def later_runs(docs: DataFrame, min_run: int = MIN_RUN, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, runs): for documents with repeated lines, the windows (start, n) that occur before (see line_dedup).

    Only the places of fingerprints that occur twice go on. There the match is extended line by line to both sides, to every window that
    selected the fingerprint; windows of the same lines meet, and all but the first are later repeats. Longer runs are unions of windows.
    """
    placed = written(winnowed(docs, min_run, min_words, id_col, text_col), "line-fingerprints")
    place = F.xxhash64("k1", "k2", "place")
    shared = placed.groupBy("fingerprint").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("fingerprint")
    middle = min_run - 1

    def window(first: int, n: int) -> Column:
        lines = [F.col("near")[i]["g"] for i in range(first, first + n)]
        return F.when(F.expr(selects(first, n, min_run, min_words)), F.struct((F.col("place") + (first - middle)).alias("start"), F.lit(n).alias("n"), F.xxhash64(*lines).alias("v")))

    windows = F.filter(F.array(*[window(i, n) for i, n in around(min_run)]), lambda x: x.isNotNull())
    extended = placed.join(shared, "fingerprint").select("fingerprint", "k1", "k2", F.explode(windows).alias("w")).select("fingerprint", "k1", "k2", "w.*")
    first = extended.groupBy("fingerprint", "n", "v").agg(F.min(F.struct("k1", "k2", "start")).alias("first"), F.max(F.struct("k1", "k2", "start")).alias("last")).where("first < last").drop("last")
    later = extended.join(first, ["fingerprint", "n", "v"]).where(F.struct("k1", "k2", "start") > F.col("first"))
    runs = written(later.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n")).alias("runs")), "line-runs")
    discard(placed)
    return runs


def line_dedup(docs: DataFrame, min_run: int = MIN_RUN, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_lines, n_removed and kept_text: the text without the lines of later repeated runs.

    Lines end at a newline and are compared without blanks, tabs and carriage returns at their ends; lines that are then empty are no part of runs,
    are not counted and stay. A run of consecutive lines that also occurs earlier (by id, a null id first, then by place; two texts with
    one id go by a hash of the text) is deleted if it has min_run lines or more, or fewer with min_words words or more together; so every such run
    stays once. Null text has no lines and stays null. Of rows with the same id and text all are kept alike, as one place. No rows give no rows.
    Columns of docs stay as they are, but for those named like the three new ones, which are replaced.
    """
    k1, k2 = document_key(id_col, text_col)
    found = later_runs(docs, min_run, min_words, id_col, text_col).withColumnsRenamed({"k1": "_k1", "k2": "_k2", "runs": "_runs"})
    keyed = docs.select(F.struct(*docs.columns).alias("row"), k1, k2, F.col(text_col).alias("text"))
    # runs compress well, so a small file is no sign of a small table
    both = keyed.join(found.hint("merge"), (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left").select("row", "text", "_runs")
    both = computed(both, lines=F.split("text", "\n"))
    full = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.btrim(F.get("lines", i), F.lit(BLANK)) != "")
    both = computed(both, full=F.when(F.col("text").isNull(), F.array().cast("array<int>")).otherwise(full))
    gone = F.array_distinct(F.flatten(F.transform("_runs", lambda r: F.transform(F.sequence(r["start"], r["start"] + r["n"] - 1), lambda i: F.get("full", i)))))
    both = computed(both, gone=F.coalesce(gone, F.array().cast("array<int>")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get("lines", i))
    text = F.when(F.col("text").isNotNull(), F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")))
    return unclashed(both, docs.columns, n_lines=F.size("full").cast("long"), n_removed=F.size("gone").cast("long"), kept_text=text)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op4_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
b AS (SELECT doc_id, p, line, trim(line, ' ' || chr(9) || chr(13)) AS t FROM l),
f AS (SELECT doc_id, p, t, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS i, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS c FROM b WHERE t <> ''),
n AS (SELECT doc_id, i, t AS t0, c AS c0, lead(t, 1) OVER d AS t1, lead(c, 1) OVER d AS c1, lead(t, 2) OVER d AS t2 FROM f WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
w AS (SELECT doc_id, i, 3 AS n, t0 || chr(10) || t1 || chr(10) || t2 AS k FROM n WHERE t2 IS NOT NULL
  UNION ALL SELECT doc_id, i, 2, t0 || chr(10) || t1 FROM n WHERE t1 IS NOT NULL AND c0 + c1 >= 50
  UNION ALL SELECT doc_id, i, 1, t0 FROM n WHERE c0 >= 50),
r AS (SELECT doc_id, i, n FROM (SELECT doc_id, i, n, row_number() OVER (PARTITION BY n, k ORDER BY doc_id, i) AS o FROM w) WHERE o > 1),
g AS (SELECT DISTINCT f.doc_id, f.p FROM f JOIN (SELECT doc_id, unnest(range(i, i + n)) AS i FROM r) x ON f.doc_id = x.doc_id AND f.i = x.i),
k AS (SELECT b.doc_id, string_agg(line, chr(10) ORDER BY b.p) AS t FROM b ANTI JOIN g ON b.doc_id = g.doc_id AND b.p = g.p GROUP BY b.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(m, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS m FROM g GROUP BY doc_id) USING (doc_id)"""
}
