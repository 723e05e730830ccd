"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good or bad or abstains on a document. The votes of all documents
collapse to counts of vote patterns (at most 3 ** len(RULES) rows, whatever the
corpus). On these, expectation-maximisation fits, for each rule, how often it
votes each way on good and on bad documents, and so its accuracy; no labels are
used. A document's verdict is its posterior probability of being good, so one
failed rule does not decide alone.

The text is read once; measures are written to the shared folder, and the
verdict is a projection of them. Nothing is shuffled but the pattern counts.

Defined cases: null and empty texts have no words and measures of 0, and fail
the base (n_words < 50); other columns, null or not, are not looked at; repeated
rows are judged each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedback_engine.llm.common import SPACE, table, written

#: (rule, SQL when it votes bad, SQL when it votes good); it abstains otherwise. Valid in Spark and DuckDB.
RULES = (
    ("symbols", "10 * n_symbols > n_words", "false"),
    ("capitals", "3 * n_upper > word_chars", "false"),
    ("shouting", "5 * n_bangs > n_words", "false"),
    ("repeats", "10 * n_repeat_words > 4 * n_words", "false"),
    ("lines", "10 * n_dup_lines > 4 * n_lines", "false"),
    ("word_length", "word_chars > 8 * n_words OR 10 * word_chars < 28 * n_words", "10 * word_chars BETWEEN 38 * n_words AND 62 * n_words"),
    ("vocabulary", "10 * n_distinct < n_words", "false"),
    ("letters", "100 * n_letters < 90 * word_chars", "100 * n_letters >= 93 * word_chars AND n_words > 0"),
    ("points", "n_points = 0 OR 10 * n_points > 9 * n_words", "100 * n_points BETWEEN 4 * n_words AND 40 * n_words"),
)
BASE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_points", "n_distinct", "n_letters")
SYMBOLS, POINTS = "#*$%&|<>", ".,;:?"
ROUNDS, SMOOTHING = 20, 0.5
#: Pattern codes have a digit for each rule: 0 abstains, 1 votes bad, 2 votes good.
CODE = " + ".join(f"CASE WHEN {bad} THEN 1 WHEN {good} THEN 2 ELSE 0 END * {3**j}" for j, (_, bad, good) in enumerate(RULES))


def _count(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit("[" + chars.replace("|", "\\|") + "]")).cast("long")


def measured(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`row`, a struct of docs' columns (those to keep), and `m`, a struct of MEASURES."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    bare = F.btrim(F.col("_text"), F.lit(SPACE))
    split = own.withColumn("_words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+")))
    split = split.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")))
    n = F.size("_words")
    triple = lambda i: F.concat_ws(" ", F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    split = split.withColumn("_three", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), triple)).otherwise(F.array().cast("array<string>")))
    # Only texts in which a window repeats are sorted.
    pairs = F.sort_array(F.transform("_three", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    split = split.withColumn("_sorted", F.when(F.size(F.array_distinct("_three")) < F.size("_three"), pairs))
    same = lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False))
    twice = F.filter("_sorted", lambda x, j: same(x, F.get("_sorted", j - 1)) | same(x, F.get("_sorted", j + 1)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    text = F.col("_text")
    values = {
        "n_words": n,
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": _count(text, SYMBOLS),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.when(F.col("_sorted").isNull(), F.lit(0)).otherwise(covered),
        "n_lines": F.size("_lines"),
        "n_upper": F.length(text) - F.length(F.regexp_replace(text, "\\p{Lu}+", "")),
        "n_bangs": _count(text, "!"),
        "n_points": _count(text, POINTS),
        "n_distinct": F.size(F.array_distinct("_words")),
        "n_letters": F.length(F.regexp_replace(text, "\\P{L}+", "")),
    }
    return split.select("row", F.struct(*[values[m].cast("long").alias(m) for m in MEASURES]).alias("m"))


def votes(code: int) -> list[int]:
    return [code // 3**j % 3 for j in range(len(RULES))]


def fitted(counts: dict[int, int], rounds: int = ROUNDS) -> tuple[dict[int, float], list[float]]:
    """From the count of each vote pattern: its posterior of being good, and each rule's estimated accuracy where it votes."""
    codes = sorted(counts)
    seen = {c: votes(c) for c in codes}
    good = {c: 0.1 if 1 in seen[c] else 0.9 if 2 in seen[c] else 0.5 for c in codes}
    total, k = sum(counts.values()), len(RULES)
    table_of = lambda share: [[0.0] * 3 for _ in range(k)]
    accuracy = [0.5] * k
    for _ in range(rounds if total else 0):
        sums = [sum(counts[c] * (1 - good[c]) for c in codes), sum(counts[c] * good[c] for c in codes)]
        odds = [table_of(0), table_of(1)]
        for c in codes:
            for j, v in enumerate(seen[c]):
                odds[0][j][v] += counts[c] * (1 - good[c])
                odds[1][j][v] += counts[c] * good[c]
        for j in range(k):
            right, cast = odds[0][j][1] + odds[1][j][2], sum(odds[x][j][v] for x in (0, 1) for v in (1, 2))
            accuracy[j] = right / cast if cast else 0.5
        log = [[[math.log((odds[x][j][v] + SMOOTHING) / (sums[x] + 3 * SMOOTHING)) for v in range(3)] for j in range(k)] for x in (0, 1)]
        prior = math.log((sums[1] + SMOOTHING) / (sums[0] + SMOOTHING))
        for c in codes:
            z = prior + sum(log[1][j][v] - log[0][j][v] for j, v in enumerate(seen[c]))
            good[c] = 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))
    return good, accuracy


def judged(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """`row`, a struct of docs' columns (those to keep), `m` (MEASURES), and `v`: base_failed, posterior, kept (posterior >= least and the base holds)."""
    rows = written(measured(docs, text_col, keep), "quality-rules")
    code = F.expr(_over(CODE))
    counts = {r["code"]: r["n"] for r in rows.groupBy(code.alias("code")).agg(F.count("*").alias("n")).collect()}  # at most 3 ** len(RULES) rows
    good, _ = fitted(counts)
    # One array literal with a place for each code: a verdict is a look-up.
    by_code = F.split(F.lit(",".join(f"{good[c]:.6f}" if c in good else "0.5" for c in range(max(good, default=0) + 1))), ",").cast("array<double>")
    failed, posterior = F.expr(_over(BASE)), F.get(by_code, code)
    return rows.select("row", "m", F.struct(failed.alias("base_failed"), posterior.alias("posterior"), (~failed & (posterior >= least)).alias("kept")).alias("v"))


def _over(sql: str) -> str:
    """The SQL with its measures taken from the struct."""
    return re.sub(rf"\b({'|'.join(MEASURES)})\b", r"m.\1", sql)


def good_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without those that the rules reject, with their columns."""
    return judged(docs, text_col).filter("v.kept").select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    rows = judged(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select("row.doc_id", *[F.col(f"m.{m}").alias(m) for m in MEASURES[:5]], "v.base_failed", "v.kept", "v.posterior")


def verdict_sql(source: str) -> str:
    """DuckDB CTEs up to `verdict` (doc_id, measures, base_failed, kept, posterior) over a relation with doc_id and text."""
    word, k = "[^\\x20\\x09-\\x0D]+", len(RULES)
    count = lambda chars: f"length(t) - length(translate(t, '{chars}', ''))"
    steps = [
        f"""src AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM {source})""",
        "tri AS MATERIALIZED (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, CAST(len(w) AS BIGINT) - 1)) AS i FROM src))",
        "twice AS (SELECT rid, i FROM tri WHERE (rid, g) IN (SELECT rid, g FROM tri GROUP BY rid, g HAVING count(*) > 1))",
        "cov AS (SELECT rid, count(DISTINCT i + d) AS n FROM twice, range(3) AS r(d) GROUP BY rid)",
        f"""m AS MATERIALIZED (SELECT src.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
            CAST({count(SYMBOLS)} AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
            len(ls) AS n_lines, length(t) - length(regexp_replace(t, '\\p{{Lu}}+', '', 'g')) AS n_upper, {count("!")} AS n_bangs, {count(POINTS)} AS n_points, len(list_distinct(w)) AS n_distinct,
            length(regexp_replace(t, '\\P{{L}}+', '', 'g')) AS n_letters
            FROM src LEFT JOIN cov ON src.rid = cov.rid)""",
        f"coded AS MATERIALIZED (SELECT *, {CODE} AS code FROM m)",
        "pat AS MATERIALIZED (SELECT code, CAST(count(*) AS DOUBLE) AS n FROM coded GROUP BY code)",
        f"pv AS MATERIALIZED (SELECT code, j, (code // CAST(pow(3, j) AS BIGINT)) % 3 AS v FROM pat, range({k}) AS r(j))",
        "e0 AS MATERIALIZED (SELECT pat.code, n, (SELECT CASE WHEN max(CAST(v = 1 AS INT)) = 1 THEN 0.1 WHEN max(CAST(v = 2 AS INT)) = 1 THEN 0.9 ELSE 0.5 END FROM pv WHERE pv.code = pat.code) AS q FROM pat)",
    ]
    for i in range(ROUNDS):
        steps += [
            f"s{i} AS MATERIALIZED (SELECT sum(n * (1 - q)) AS b, sum(n * q) AS g FROM e{i})",
            f"""l{i} AS MATERIALIZED (SELECT j, v, ln((sum(n * q) + {SMOOTHING}) / (any_value(g) + {3 * SMOOTHING})) - ln((sum(n * (1 - q)) + {SMOOTHING}) / (any_value(b) + {3 * SMOOTHING})) AS w
                FROM e{i} JOIN pv USING (code), s{i} GROUP BY j, v)""",
            f"""e{i + 1} AS MATERIALIZED (SELECT e{i}.code, any_value(e{i}.n) AS n, 1 / (1 + exp(-greatest(-700.0, least(700.0, any_value(ln((g + {SMOOTHING}) / (b + {SMOOTHING}))) + sum(w))))) AS q
                FROM e{i} JOIN pv ON pv.code = e{i}.code JOIN l{i} ON l{i}.j = pv.j AND l{i}.v = pv.v, s{i} GROUP BY e{i}.code)""",
        ]
    steps.append(f"""verdict AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE}) AS base_failed, NOT ({BASE}) AND round(q, 6) >= 0.5 AS kept, round(q, 6) AS posterior
        FROM coded JOIN e{ROUNDS} USING (code))""")
    return ",\n".join(steps)


OP1_SQL = f"WITH {verdict_sql('documents')}\nSELECT * FROM verdict"
