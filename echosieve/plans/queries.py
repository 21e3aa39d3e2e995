"""The engine's operators as queries over the test tables, with the SQL that should give the same rows.

The tables hold no source code, so a document, a conversation's turn or a
benchmark passage stands for a block, a document's source for its file and its
language for the programming language. Tokens are words, numbers and single
other characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echosieve.config import IntraConfig, Scope
from echosieve.functions import columns as C
from echosieve.functions.similarity import blended_udf
from echosieve.operators import detect as D
from echosieve.operators import scope as S
from echosieve.operators.blocks import text_blocks
from echosieve.operators.candidates import similar_pairs, text_classes
from echosieve.operators.intra import detect_intra
from echosieve.operators.numbering import number_rows
from echosieve.sources.diff import parse_diff
from echosieve.sources.encoding import detect_encoding_col, to_utf8_col
from echosieve.storage import materialize

WINDOW, LEAST, SHARED, PERCENT = 10, 30, 3, 80
#: Passes over the texts that write their windows, some 2.5 times the input in all.
PASSES = 3
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- shared parts of the SQL ----------------------------------------------------

_RE = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\x20\x09-\x0DA-Za-z0-9_]"
_TOKENS = f"tok AS (SELECT *, regexp_extract_all(coalesce(text, ''), '{_RE}') AS t FROM documents)"
_BLOCKS = f"{_TOKENS}, blk AS (SELECT *, len(t)::BIGINT AS n FROM tok WHERE len(t) >= {LEAST})"
_WINDOWS = f"{_BLOCKS}, win AS (SELECT DISTINCT doc_id, n, array_to_string(t[i:i + {WINDOW - 1}], chr(1)) AS fp FROM (SELECT doc_id, t, n, unnest(range(1, n - {WINDOW - 2})) AS i FROM blk))"
_CAPPED = f"{_WINDOWS}, freq AS (SELECT fp, count(*) AS c FROM win GROUP BY fp), kept AS (SELECT win.* FROM win JOIN freq USING (fp) WHERE c >= 2 AND c <= (SELECT greatest(50, count(*) // 2) FROM blk))"
_SHARED = f"{_CAPPED}, shared AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS len_a, y.n AS len_b, count(*) AS shared FROM kept x JOIN kept y ON x.fp = y.fp AND x.doc_id < y.doc_id GROUP BY ALL)"
_RATIO = f"{_SHARED}, near AS (SELECT * FROM shared WHERE shared >= {SHARED} AND 200 * least(len_a, len_b) >= {PERCENT} * (len_a + len_b))"
_BAGS = (
    f"{_RATIO}, bag AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(t) AS w FROM blk) GROUP BY ALL), "
    "common AS (SELECT a, b, len_a, len_b, shared, sum(least(x.c, y.c))::BIGINT AS common FROM near JOIN bag x ON x.doc_id = a JOIN bag y ON y.doc_id = b AND y.w = x.w GROUP BY ALL), "
    f"edge AS (SELECT *, 2.0::DOUBLE * common / (len_a + len_b) AS similarity FROM common WHERE 200 * common >= {PERCENT} * (len_a + len_b))"
)
_GROUPS = (
    f"RECURSIVE {_BAGS}, link AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge), "
    "reach(doc_id, other) AS (SELECT a, b FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other), "
    "member AS (SELECT doc_id, least(doc_id, min(other)) AS group_id FROM reach GROUP BY doc_id), "
    "avgs AS (SELECT group_id, avg(similarity) AS avg_similarity FROM edge JOIN member ON member.doc_id = edge.a GROUP BY group_id), "
    "grp AS (SELECT group_id, count(*) AS size, avg_similarity FROM member JOIN avgs USING (group_id) GROUP BY ALL)"
)
_SOURCED = f"{_GROUPS}, placed AS (SELECT member.doc_id, group_id, source, lang FROM member JOIN documents USING (doc_id))"
_CHANGES = "changes AS (SELECT doc_id, 1 AS first, 1 + 2 * quality AS last FROM labels), lined AS (SELECT doc_id, 3 AS s, len(string_split(coalesce(text, ''), chr(10))) AS e FROM documents), changed AS (SELECT DISTINCT l.doc_id FROM lined l JOIN changes c ON c.doc_id = l.doc_id AND c.first <= l.e AND c.last >= l.s)"


# --- shared parts of the plans ----------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str, *carried: str) -> DataFrame:
    return text_blocks(_table(spark, sf_dir, "documents").select("doc_id", "text", *carried), "doc_id", "text", LEAST, False, *carried)


def _tokens(spark: SparkSession, sf_dir: str, *carried: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", *carried)
    return C.settle(docs, t=C.prose_tokens(F.col("text"))).drop("text")


class _Found:
    """Classes of documents, and pairs of classes after each step."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"), "text")
        self.texts, self.classes, self.members = text_classes(docs, LEAST)
        self.n = self.classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        self.cap = D.frequency_cap(self.n)

    def shared(self, least: int = 1, share: float = 0.0) -> DataFrame:
        """Pairs of documents, as many as there are: they are made in the cells, not joined."""
        return similar_pairs(self.texts, WINDOW, self.cap, least, passes=PASSES, last=True, share=share, members=self.members)

    def near(self) -> DataFrame:
        return similar_pairs(self.texts, WINDOW, self.cap, SHARED, PERCENT, passes=PASSES, last=True, members=self.members)

    def bags(self, aligned: bool = False) -> DataFrame:
        """Pairs whose bags, or texts if ``aligned``, reach the threshold, with the size of the common bag or subsequence."""
        rows = materialize(similar_pairs(self.texts, WINDOW, self.cap, SHARED, PERCENT, True, PASSES, last=True, aligned=aligned), "bags")
        return rows.withColumn("similarity", 2.0 * F.col("common") / (F.col("len_a") + F.col("len_b")))

    def documents(self, pairs: DataFrame) -> DataFrame:
        """Pairs of documents from pairs of classes."""
        side = lambda s: self.members.select(F.col("block_id").alias(f"block_{s}"), F.col("class_id").alias(s))
        both = pairs.join(side("a"), "a").join(side("b"), "b").filter("a < b or block_a < block_b")
        first = F.col("block_a") < F.col("block_b")
        flip = {"len_a": F.when(first, F.col("len_a")).otherwise(F.col("len_b")), "len_b": F.when(first, F.col("len_b")).otherwise(F.col("len_a"))}
        others = [flip.get(c, F.col(c)).alias(c) for c in pairs.columns if c not in ("a", "b")]
        return both.select(F.least("block_a", "block_b").alias("a"), F.greatest("block_a", "block_b").alias("b"), *others)

    def groups(self, aligned: bool = False) -> tuple[DataFrame, DataFrame]:
        size = self.classes.select("class_id", "n")
        pairs = self.bags(aligned).join(size.withColumnsRenamed({"class_id": "a", "n": "n_a"}), "a").join(size.withColumnsRenamed({"class_id": "b", "n": "n_b"}), "b")
        weight = F.when(F.col("a") == F.col("b"), F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b"))
        return D.group_pairs(materialize(pairs.select("a", "b", "similarity", weight.cast("bigint").alias("weight")), "edges"), self.members)


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    groups, averages = _Found(spark, sf_dir).groups()
    files = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"), F.col("source").alias("file_id"), "lang")
    return groups, averages, files


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a changed line; a label stands for a change of the lines 1 to 1 or 3, a document starts at its third line."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"), F.col("doc_id").alias("path"), F.lit(3).alias("start_line"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("end_line"))
    changes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.lit(1).alias("start_line"), (1 + 2 * F.col("quality")).alias("end_line"))
    return S.changed_blocks(docs, changes).select("block_id").distinct()


def _turns(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """Each turn with the one before it, both of at most ``most`` tokens: (conv_id, turn, a, b, sa, sb)."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    rows = C.settle(rows, t=C.prose_tokens(F.col("text")))
    before = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.select("conv_id", "turn", F.col("t").alias("a"), F.lag("t").over(before).alias("b"))
    rows = rows.filter(F.col("b").isNotNull() if most is None else (F.size("a") <= most) & (F.size("b") <= most))
    return C.settle(rows, sa=C.structural_ids(F.col("a")), sb=C.structural_ids(F.col("b")))


# --- tokens and windows ----------------------------------------------------------------


@query(f"WITH {_TOKENS} SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM tok")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


@query(f"WITH {_TOKENS} SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(t) AS token FROM tok) GROUP BY ALL")
def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, "lang").select("lang", F.explode("t").alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))


@query(f"WITH {_TOKENS}, kinds AS (SELECT doc_id, CASE WHEN regexp_matches(w, '^[A-Za-z_]') THEN 'w' WHEN regexp_matches(w, '^[0-9]') THEN 'n' ELSE w END AS kind FROM (SELECT doc_id, unnest(t) AS w FROM tok)) SELECT doc_id, kind, count(*) AS n FROM kinds GROUP BY ALL")
def structural_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select("doc_id", F.explode(C.structural_ids(F.col("t"))).alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query(f"WITH {_BLOCKS} SELECT doc_id, n AS n_tokens FROM blk")
def min_token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).filter(F.size("t") >= LEAST).select("doc_id", F.size("t").cast("bigint").alias("n_tokens"))


@query(f"WITH {_WINDOWS} SELECT doc_id, (n - {WINDOW - 1})::BIGINT AS n_windows, count(*) AS n_distinct FROM win GROUP BY ALL")
def window_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.settle(_documents(spark, sf_dir), w=C.window_hashes(F.col("struct_ids"), WINDOW))
    return rows.select(F.col("block_id").alias("doc_id"), F.size("w").cast("bigint").alias("n_windows"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"))


@query(
    f"WITH {_BLOCKS}, ids AS (SELECT doc_id, list_transform(t, lambda x: length(x)::HUGEINT) AS ids, n FROM blk), "
    f"fps AS (SELECT doc_id, list_reduce(list_prepend(0::HUGEINT, ids[i:i + {WINDOW - 1}]), lambda h, x: (h * 257 + x) % {C.PRIME}) AS fp FROM (SELECT doc_id, ids, unnest(range(1, n - {WINDOW - 2})) AS i FROM ids)) "
    "SELECT doc_id, count(DISTINCT fp) AS n_distinct, min(fp)::BIGINT AS least, max(fp)::BIGINT AS greatest FROM fps GROUP BY doc_id"
)
def poly_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact polynomial window hashes of the token lengths."""
    rows = _tokens(spark, sf_dir).filter(F.size("t") >= LEAST)
    rows = C.settle(rows, ids=F.transform("t", lambda x: F.length(x).cast("bigint")))
    rows = C.settle(rows.select("doc_id", "ids"), fps=C.poly_windows(F.col("ids"), WINDOW))
    return rows.select("doc_id", F.size(F.array_distinct("fps")).cast("bigint").alias("n_distinct"), F.array_min("fps").alias("least"), F.array_max("fps").alias("greatest"))


@query(f"WITH {_WINDOWS} SELECT c AS n_blocks, count(*) AS n_windows FROM (SELECT fp, count(*) AS c FROM win GROUP BY fp) GROUP BY c")
def posting_list_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = D.content_classes(_documents(spark, sf_dir))
    return D.fingerprints(classes, WINDOW).groupBy("fp").agg(F.sum("n").alias("n_blocks")).groupBy("n_blocks").agg(F.count("*").alias("n_windows"))


@query(f"WITH {_CAPPED} SELECT doc_id, count(*) AS n_kept FROM kept GROUP BY doc_id")
def capped_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, members = D.content_classes(_documents(spark, sf_dir))
    n = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    windows = D.capped(materialize(D.fingerprints(classes, WINDOW), "windows"), D.frequency_cap(n))
    kept = windows.groupBy("class_id").agg(F.count("*").alias("n_kept"))
    return members.join(kept, "class_id").select(F.col("block_id").alias("doc_id"), "n_kept")


# --- candidate pairs ---------------------------------------------------------------------


@query(f"WITH {_SHARED} SELECT a, b, shared FROM shared")
def shared_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _Found(spark, sf_dir)
    return found.shared().select("a", "b", "shared")


@query(f"WITH {_SHARED} SELECT a, b, len_a, len_b, shared FROM shared WHERE shared >= {SHARED}")
def candidates_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _Found(spark, sf_dir)
    return found.shared(SHARED).select("a", "b", "len_a", "len_b", "shared")


_SURVIVE = (1.0 - (1.0 - 0.97) * WINDOW) * 0.5


@query(
    f"WITH {_SHARED}, need AS (SELECT *, greatest({SHARED}, floor({_SURVIVE!r}::DOUBLE * least(CASE WHEN len_a > {WINDOW} THEN len_a - {WINDOW - 1} ELSE 0 END, CASE WHEN len_b > {WINDOW} THEN len_b - {WINDOW - 1} ELSE 0 END))::BIGINT) AS needed FROM shared) "
    "SELECT a, b, shared, needed FROM need WHERE shared >= needed"
)
def candidates_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _Found(spark, sf_dir)
    rows = found.shared(SHARED, _SURVIVE).withColumn("needed", C.least_shared(F.col("len_a"), F.col("len_b"), WINDOW, SHARED, 0.97))
    return rows.filter("shared >= needed").select("a", "b", "shared", "needed")


@query(f"WITH {_RATIO} SELECT a, b, len_a, len_b FROM near")
def length_ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _Found(spark, sf_dir)
    return found.near().select("a", "b", "len_a", "len_b")


@query(f"WITH {_BAGS} SELECT a, b, common, round(similarity, 6) AS similarity FROM edge")
def bag_dice_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _Found(spark, sf_dir)
    return found.documents(found.bags()).select("a", "b", "common", F.round("similarity", 6).alias("similarity"))


# --- similarity ------------------------------------------------------------------------------

_TURNS = f"turns AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '{_RE}') AS a FROM conversations), both_turns AS (SELECT conv_id, turn, a, lag(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM turns), pair AS (SELECT * FROM both_turns WHERE len(a) <= 62 AND len(b) <= 62)"
_MASKS = "list_transform({a}, lambda x: coalesce(list_sum(list_transform(range(0, len({b})), lambda j: CASE WHEN {b}[j + 1] = x THEN 1::HUGEINT << j::INT ELSE 0::HUGEINT END)), 0)::HUGEINT)"
_STEP = "lambda m, p: (m | p) & xor((m | p) - ((m << 1) | 1), (m | p))"


def _lcs_sql(a: str, b: str) -> str:
    masks = _MASKS.format(a=a, b=b)
    return f"bit_count(list_reduce(list_prepend(0::HUGEINT, {masks}), {_STEP}))::BIGINT"


@query(f"WITH {_TURNS} SELECT conv_id, turn, {_lcs_sql('a', 'b')} AS lcs, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 2.0::DOUBLE * {_lcs_sql('a', 'b')} / (len(a) + len(b)) END, 6) AS similarity FROM pair")
def lcs_dice_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.settle(_turns(spark, sf_dir, 62), lcs=C.lcs_short(F.col("a"), F.col("b")).cast("bigint"))
    return rows.select("conv_id", "turn", "lcs", F.round(C.dice(F.col("lcs"), F.size("a"), F.size("b")), 6).alias("similarity"))


_CLASS = "list_transform({x}, lambda w: CASE WHEN regexp_matches(w, '^[A-Za-z_]') THEN 'w' WHEN regexp_matches(w, '^[0-9]') THEN 'n' ELSE w END)"


@query(
    f"WITH {_TURNS}, plain AS (SELECT *, {_CLASS.format(x='a')} AS sa, {_CLASS.format(x='b')} AS sb FROM pair WHERE len(a) > 0 AND len(b) > 0), "
    f"sims AS (SELECT conv_id, turn, 2.0::DOUBLE * {_lcs_sql('sa', 'sb')} / (len(a) + len(b)) AS s, 2.0::DOUBLE * {_lcs_sql('a', 'b')} / (len(a) + len(b)) AS t FROM plain) "
    "SELECT conv_id, turn, round(0.7::DOUBLE * s + 0.3::DOUBLE * t, 6) AS similarity FROM sims"
)
def blended_similarity_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blend of turns of at most 62 tokens, as many as its SQL can hold; ``blended_similarity_exact_all`` has no limit."""
    rows = _turns(spark, sf_dir, 62).filter((F.size("a") > 0) & (F.size("b") > 0))
    rows = C.settle(rows, s=C.lcs_short(F.col("sa"), F.col("sb")), t=C.lcs_short(F.col("a"), F.col("b")))
    of = lambda c: C.dice(F.col(c), F.size("a"), F.size("b"))
    return rows.select("conv_id", "turn", F.round(C.blended(of("s"), of("t"), 0.3), 6).alias("similarity"))


def _blended_turns(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    rows = _turns(spark, sf_dir)
    ids = [C.token_ids(F.col(c)) for c in ("sa", "sb", "a", "b")]
    return rows.select("conv_id", "turn", F.round(blended_udf(0.3, 0.8, mode)(*ids), 6).alias("similarity"))


@query()
def blended_similarity_exact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blend of all consecutive turns, of any length."""
    return _blended_turns(spark, sf_dir, "exact")


@query()
def blended_similarity_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blended_turns(spark, sf_dir, "compat")


@query()
def lcs_dice_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar documents, by the whole cascade; at this threshold the adaptive least number is that of the other steps."""
    found = _Found(spark, sf_dir)
    return found.documents(found.bags(True)).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query()
def clone_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of similar documents, by the whole cascade: one row a document."""
    groups, averages = _Found(spark, sf_dir).groups(True)
    return groups.join(averages, "group_id").select("group_id", F.col("block_id").alias("doc_id"), "size", F.round("avg_similarity", 6).alias("avg_similarity"))


# --- groups ----------------------------------------------------------------------------------------


@query(f"WITH {_GROUPS} SELECT group_id, doc_id FROM member")
def clone_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _ = _Found(spark, sf_dir).groups()
    return groups.select("group_id", F.col("block_id").alias("doc_id"))


@query(f"WITH {_GROUPS} SELECT group_id, size, round(avg_similarity, 6) AS avg_similarity FROM grp")
def group_avg_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, averages = _Found(spark, sf_dir).groups()
    return averages.select("group_id", "size", F.round("avg_similarity", 6).alias("avg_similarity"))


_ORDER = "ORDER BY size DESC, round(avg_similarity, 6) DESC, group_id"


def _ranked(averages: DataFrame) -> DataFrame:
    rounded = averages.select("group_id", "size", F.round("avg_similarity", 6).alias("avg_similarity"))
    numbered = number_rows(rounded, [F.desc("size"), F.desc("avg_similarity"), F.asc("group_id")], "rank")
    return numbered.withColumn("rank", (F.col("rank") + 1).cast("int"))


@query(f"WITH {_GROUPS} SELECT group_id, size, round(avg_similarity, 6) AS avg_similarity, row_number() OVER ({_ORDER})::INTEGER AS rank FROM grp")
def groups_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, averages = _Found(spark, sf_dir).groups()
    return _ranked(averages)


@query(f"WITH {_GROUPS} SELECT group_id, size, round(avg_similarity, 6) AS avg_similarity, row_number() OVER ({_ORDER})::INTEGER AS rank FROM grp WHERE avg_similarity >= 0.9 ORDER BY rank LIMIT 20 OFFSET 5")
def groups_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of groups: the second of a report, filtered first."""
    _, averages = _Found(spark, sf_dir).groups()
    return _ranked(averages.filter("avg_similarity >= 0.9")).orderBy("rank").offset(5).limit(20)


@query(f"WITH {_SOURCED} SELECT group_id, doc_id FROM placed WHERE group_id IN (SELECT group_id FROM placed GROUP BY group_id HAVING count(DISTINCT source) >= 2)")
def scope_inter_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _, files = _placed(spark, sf_dir)
    return S.filter_scope(groups, files, Scope.INTER_FILE).select("group_id", F.col("block_id").alias("doc_id"))


@query(f"WITH {_SOURCED} SELECT group_id, source, doc_id FROM placed JOIN (SELECT group_id, source FROM placed GROUP BY ALL HAVING count(*) >= 2) USING (group_id, source)")
def scope_intra_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _, files = _placed(spark, sf_dir)
    return S.filter_scope(groups, files, Scope.INTRA_FILE).select("group_id", F.col("file_id").alias("source"), F.col("block_id").alias("doc_id"))


@query(f"WITH {_SOURCED} SELECT group_id, count(*) AS size, count(DISTINCT lang) AS n_langs FROM placed GROUP BY group_id")
def cross_language_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many languages each group spans; languages are never compared apart."""
    groups, _, files = _placed(spark, sf_dir)
    return groups.join(files, "block_id").groupBy("group_id").agg(F.count("*").alias("size"), F.countDistinct("lang").alias("n_langs"))


_FILE = "source = 'src0'"


@query(f"WITH {_SOURCED} SELECT group_id, count(*) AS size, count(*) FILTER ({_FILE}) AS own FROM placed GROUP BY group_id HAVING count(*) FILTER ({_FILE}) > 0")
def file_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with a document of one source."""
    groups, _, files = _placed(spark, sf_dir)
    own = F.count(F.when(F.col("file_id") == "src0", 1))
    return groups.join(files, "block_id").groupBy("group_id").agg(F.count("*").alias("size"), own.alias("own")).filter("own > 0")


@query(f"WITH {_SOURCED}, own AS (SELECT group_id, count(*) AS size, count(*) FILTER ({_FILE}) AS own FROM placed GROUP BY group_id) SELECT group_id, 'within' AS category FROM own WHERE own >= 2 UNION ALL SELECT group_id, 'cross' FROM own WHERE own > 0 AND own < size")
def within_vs_cross_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _, files = _placed(spark, sf_dir)
    return S.within_and_across(groups, files, F.lit("src0"))


@query(f"WITH {_GROUPS} SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM blk) AS blocks, (SELECT count(*) FROM grp) AS groups, (SELECT count(*) FROM member) AS grouped_blocks, (SELECT sum(len(string_split(coalesce(text, ''), chr(10))))::BIGINT FROM member JOIN documents USING (doc_id)) AS duplicated_lines")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _Found(spark, sf_dir)
    groups, averages = found.groups()
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("bigint").alias("lines"))
    files = docs.agg(F.count("*").alias("files"))
    blocks = found.classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("blocks"))
    grouped = groups.join(docs, "block_id").agg(F.count("*").alias("grouped_blocks"), F.sum("lines").alias("duplicated_lines"))
    return files.crossJoin(blocks).crossJoin(averages.agg(F.count("*").alias("groups"))).crossJoin(grouped)  # one row each


@query(f"WITH {_GROUPS} SELECT source, count(*) AS blocks, sum(len(string_split(coalesce(text, ''), chr(10))))::BIGINT AS duplicated_lines FROM member JOIN documents USING (doc_id) GROUP BY source")
def duplicated_lines_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _ = _Found(spark, sf_dir).groups()
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"), "source", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("bigint").alias("lines"))
    return groups.join(docs, "block_id").groupBy("source").agg(F.count("*").alias("blocks"), F.sum("lines").alias("duplicated_lines"))


# --- changes -----------------------------------------------------------------------------------------


@query(f"WITH {_CHANGES} SELECT doc_id FROM changed")
def changed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).select(F.col("block_id").alias("doc_id"))


@query(f"WITH {_GROUPS}, {_CHANGES} SELECT group_id, doc_id FROM member WHERE group_id IN (SELECT group_id FROM member JOIN changed USING (doc_id))")
def diff_filtered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _ = _Found(spark, sf_dir).groups()
    return S.filter_changed(groups, _changed(spark, sf_dir)).select("group_id", F.col("block_id").alias("doc_id"))


@query(f"WITH {_GROUPS}, {_CHANGES} SELECT group_id, CASE WHEN count(c.doc_id) < count(*) THEN 'existing' ELSE 'new' END AS category FROM member m LEFT JOIN changed c ON c.doc_id = m.doc_id GROUP BY group_id HAVING count(c.doc_id) > 0")
def duplicates_existing_vs_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _ = _Found(spark, sf_dir).groups()
    return S.categorize_changed(groups, _changed(spark, sf_dir))


# --- inside a block --------------------------------------------------------------------------------------


@query("WITH line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) SELECT doc_id, line, count(*) AS n FROM line WHERE length(line) >= 20 GROUP BY ALL HAVING count(*) >= 2")
def repeated_lines_in_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).filter(F.length("line") >= 20)
    return lines.groupBy("doc_id", "line").agg(F.count("*").alias("n")).filter("n >= 2")


@query()
def intra_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect_intra(_documents(spark, sf_dir), IntraConfig())
    return found.select(F.col("block_id").alias("doc_id"), F.inline("pairs"))


# --- known snippets ------------------------------------------------------------------------------------------


@query(
    f"WITH {_WINDOWS}, item AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '{_RE}') AS t FROM benchmark), "
    f"known AS (SELECT DISTINCT item_id, array_to_string(t[i:i + {WINDOW - 1}], chr(1)) AS fp FROM (SELECT item_id, t, unnest(range(1, len(t) - {WINDOW - 2})) AS i FROM item WHERE len(t) >= {LEAST})) "
    "SELECT doc_id, item_id, count(*) AS shared FROM win JOIN known USING (fp) GROUP BY ALL"
)
def benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold windows of benchmark passages. Joined by hash; Spark broadcasts the passages only if they are small."""
    windows = lambda blocks: blocks.select("block_id", F.explode(F.array_distinct(C.window_hashes(F.col("struct_ids"), WINDOW))).alias("fp"))
    docs = windows(_documents(spark, sf_dir))
    known = windows(text_blocks(_table(spark, sf_dir, "benchmark"), "item_id", "text", LEAST)).withColumnRenamed("block_id", "item_id")
    return docs.join(known, "fp").groupBy(F.col("block_id").alias("doc_id"), "item_id").agg(F.count("*").alias("shared"))


# --- files, diffs, encodings ----------------------------------------------------------------------------------

_PATH = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '')"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", "")
    return _table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


@query(f"SELECT page_id FROM pages WHERE regexp_matches(regexp_extract({_PATH}, '[^/]*$'), '^(?:.*\\.html|[1-3]?.)$')")
def glob_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    globs = ["*.html", "1?", "2?", "3?", "?"]
    return _paths(spark, sf_dir).filter(C.glob_match(C.file_name(F.col("path")), globs)).select("page_id")


@query(f"SELECT lower(regexp_extract({_PATH}, '[^/](\\.[^./]*)$', 1)) AS extension, count(*) AS n FROM pages GROUP BY ALL")
def extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).groupBy(C.extension(F.col("path")).alias("extension")).agg(F.count("*").alias("n"))


@query(
    "WITH h AS (SELECT doc_id, source || '/' || doc_id || '.cpp' AS path, (n_chars % 50 + 1)::INTEGER AS start_line, (doc_id % 5)::INTEGER AS count FROM documents) "
    "SELECT doc_id, path, start_line, start_line + count - 1 AS end_line FROM h WHERE count > 0 UNION ALL SELECT doc_id, path, start_line + 100, start_line + 100 FROM h"
)
def parse_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff for every document: a changed, a single-line, a deleted-only and a malformed hunk, and a deleted and a binary file."""
    docs = _table(spark, sf_dir, "documents")
    name = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".cpp")))
    start = F.col("n_chars") % 50 + 1
    text: Column = F.concat_ws(
        "\n",
        F.concat(F.lit("diff --git a/old b/"), name), F.concat(F.lit("+++ b/"), name), F.concat(F.lit("@@ -1,2 +"), start, F.lit(","), F.col("doc_id") % 5, F.lit(" @@ int f()")), F.lit("+x"),
        F.concat(F.lit("@@ -9 +"), start + 100, F.lit(" @@")), F.lit("@@ broken @@"),
        F.lit("diff --git a/gone.cpp b/gone.cpp"), F.lit("+++ /dev/null"), F.lit("@@ -1,2 +1,2 @@"), F.lit("diff --git a/x.cpp b/x.cpp"), F.lit("Binary files a/x.cpp and b/x.cpp differ"), F.lit("@@ -1 +1 @@"),
        F.lit("diff --git a/notes.txt b/notes.txt"), F.lit("@@ -1 +1 @@"),
    )
    lines = docs.select(F.col("doc_id").alias("diff_id"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return parse_diff(lines, [".cpp", ".hpp"]).select(F.col("diff_id").alias("doc_id"), "path", "start_line", "end_line")


@query("SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[^\\x00-\\x7F]') THEN 'windows-1252' ELSE 'utf-8' END AS encoding, text FROM documents")
def decoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files in Latin-1, which Windows-1252 extends, told from UTF-8 and decoded again."""
    raw = F.encode("text", "iso-8859-1")
    rows = _table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    return rows.select("doc_id", F.coalesce(detect_encoding_col(F.col("raw")), F.lit("utf-8")).alias("encoding"), to_utf8_col(F.col("raw")).cast("string").alias("text"))


@query("SELECT doc_id, array_to_string(string_split(coalesce(text, ''), chr(10))[2:4], chr(10)) AS source FROM documents")
def source_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 2 to 4 of every document."""
    return _table(spark, sf_dir, "documents").select("doc_id", C.source_lines(F.coalesce("text", F.lit("")), F.lit(2), F.lit(4)).alias("source"))
