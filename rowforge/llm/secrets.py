r"""Secret scans with corpus-wide ownership, with DataFrame functions only.

Rules find spans in every text. The values found, and every other long token with digits and letters, are
candidates: their hashes are counted over the corpus by distinct repositories and distinct owners. A value that more
than ``max_owners`` owners hold, or that is in more than ``max_repositories`` repositories, be it of one owner, is a
widely copied example; any other is live-looking. Live-looking tokens outside the rules' spans are added as spans of
kind ``live``; the rules' own spans always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, join_counted

#: The rules, in the contract's order (fixed values): kind, pattern, group that holds the value, its least length.
RULES = (
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: What costs less and finds the same as a rule whose short matches are dropped.
FASTER = {"hex": r"(?<![0-9a-f])[0-9a-f]{32,}+"}
#: A token that may be a credential without any word before it.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "live")


HIT = "array<struct<k:int,i:int,gap:int,size:int,keep:boolean,v:bigint>>"
SPAN = "array<struct<at:int,k:int,to:int,kind:string,v:bigint>>"


def _hits(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """The matches in order as structs ``k, i, gap, size, keep, v``: code points from the match before, and its own; v
    hashes the value, and ``keep`` tells whether that is long enough."""
    one = F.lit(pattern)
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, one, 0).alias("hit"), F.regexp_extract_all(text, one, group).alias("value"))

    def hit(x: Column, i: Column) -> Column:
        return F.struct(
            F.lit(KINDS.index(kind)).alias("k"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"),
            (F.length(x["value"]) >= least).alias("keep"), F.xxhash64(x["value"]).alias("v"),
        )

    found = F.filter(F.transform(pairs, hit), lambda x: x["size"].isNotNull())  # what follows the last match is none
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(HIT))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["to"].cast("string"))))


def _spans(rows: DataFrame) -> DataFrame:
    """``n, owner, repo, at, k, to, v`` of the rules' spans and of the tokens apart from them, from rows with ``hits``.

    Places are running sums over a text's matches, and whether a token meets a rule's span is told by the spans next
    to it, so the work grows with the number of matches, sorted and spilled where one text has very many.
    """
    hits = rows.filter(F.size("hits") > 0).select("n", "owner", "repo", F.explode("hits").alias("h")).select("n", "owner", "repo", "h.*").repartition("n")
    so_far = Window.partitionBy("n", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = hits.withColumn("to", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int")).filter("keep").withColumn("at", F.col("to") - F.col("size"))
    text, rule = Window.partitionBy("n"), F.col("k") < KINDS.index("live")
    before = text.orderBy("at", "k").rowsBetween(Window.unboundedPreceding, -1)
    after = text.orderBy(F.desc("at"), F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("ended", F.max(F.when(rule, F.col("to"))).over(before)).withColumn("begins", F.min(F.when(rule, F.col("at"))).over(after))
    meets = F.coalesce(F.col("ended") > F.col("at"), F.lit(False)) | F.coalesce(F.col("begins") < F.col("to"), F.lit(False))
    return spans.filter(rule | ~meets).select("n", "owner", "repo", "at", "k", "to", "v")


def _judged(docs: DataFrame, max_owners: int, id_col: str, text_col: str, owner_col: str, repository_col: str, max_repositories: int) -> tuple[DataFrame, DataFrame]:
    """``n, doc_id, text_hash, some`` of each row (some: it has matches), and ``n, at, k, to, kind, v, owners, repos, live``
    of the spans: all of the rules, and of the tokens those that are live-looking."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = [_hits(text, kind, FASTER.get(kind, pattern), group, least) for kind, pattern, group, least in (*RULES, ("live", TOKEN, 0, 20))]
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(owner_col).cast("string").alias("owner"),
        F.col(repository_col).cast("string").alias("repo"), F.concat(*found).alias("hits"),
    )
    rows = cut(rows.withColumn("n", F.monotonically_increasing_id()), "secrets")  # written, so n is fixed
    spans = cut(_spans(rows), "secrets-spans")
    owners = spans.select("v", "owner").distinct().groupBy("v").agg(F.count("*").alias("owners"))
    repos = spans.select("v", "repo").distinct().groupBy("v").agg(F.count("*").alias("repos"))
    counts = cut(spans.groupBy("v").agg(F.count("*").alias("rows")).join(owners, "v").join(repos, "v"), "secrets-values")
    spans = join_counted(spans, counts, "v", "rows", spans.count())
    live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repositories)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("k") + 1)
    spans = spans.select("n", "at", "k", "to", kind.alias("kind"), "v", "owners", "repos", live.alias("live")).filter(F.col("live") | (F.col("k") < KINDS.index("live")))
    return rows.select("n", "doc_id", "text_hash", (F.size("hits") > 0).alias("some")), spans


def scan(
    docs: DataFrame,
    max_owners: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repository_col: str = "doc_id",
    max_repositories: int = 10,
) -> DataFrame:
    """``doc_id, text_hash, base, spans, n_example, n_live`` of each row.

    ``base`` and ``spans`` are arrays of structs ``at, k, to, kind, v``, sorted by place and kind; those of ``spans`` also
    have the value's numbers of ``owners`` and ``repos``. n_example counts the spans whose value more than ``max_owners``
    owners or more than ``max_repositories`` repositories hold, n_live the others. A null or empty text has no spans; a
    null owner or repository counts as one of its own; repeated rows are scanned alike and count once; an empty
    table gives an empty result. Other columns are not read.
    """
    rows, spans = _judged(docs, max_owners, id_col, text_col, owner_col, repository_col, max_repositories)
    one = F.struct("at", "k", "to", "kind", "v")
    whole = spans.groupBy("n").agg(
        F.array_sort(F.collect_list(F.when(F.col("k") < KINDS.index("live"), one))).alias("base"), F.array_sort(F.collect_list(F.struct(one["at"].alias("at"), "k", "to", "kind", "v", "owners", "repos"))).alias("spans"),
        F.count_if(~F.col("live")).alias("n_example"), F.count_if("live").alias("n_live"),
    )
    none = {c: F.array().cast(whole.schema[c].dataType) for c in ("base", "spans")} | {c: F.lit(0).cast("long") for c in ("n_example", "n_live")}
    with_spans = rows.filter("some").join(whole, "n", "left").select("doc_id", "text_hash", *[F.coalesce(c, x).alias(c) for c, x in none.items()])
    return with_spans.unionByName(rows.filter("not some").select("doc_id", "text_hash", *[x.alias(c) for c, x in none.items()]))


def report(scanned: DataFrame) -> DataFrame:
    """The contract's columns of what :func:`scan` returns."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id", *map(count, KINDS[:3]), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), "n_example", "n_live",
    )


#: Code points of a text that are masked at once, and how many spans are sent to the rows; more are met by a join.
CHUNK, SENT_SPANS = 4096, 100_000


def redact(
    docs: DataFrame,
    mask: str = "[SECRET]",
    max_owners: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repository_col: str = "doc_id",
    max_repositories: int = 10,
    length_col: str = "n_chars",
) -> DataFrame:
    """``docs`` with every span of :func:`scan` (those that overlap as one) replaced by ``mask`` and ``length_col``, if
    there, brought up to date. Nulls, empty texts, repeated rows and empty tables are as there.

    Rows without a match come through as they are, without a shuffle; the others meet their spans by id and text, which
    are sent to them if they are SENT_SPANS at most.
    """
    rows, spans = _judged(docs, max_owners, id_col, text_col, owner_col, repository_col, max_repositories)
    in_order = Window.partitionBy("n").orderBy("at", "to")
    covered = F.max("to").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    apart = spans.withColumn("new", F.coalesce((F.col("at") >= covered).cast("int"), F.lit(1)))
    apart = apart.withColumn("g", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    masks = apart.groupBy("n", "g").agg(F.min("at").alias("at"), F.max("to").alias("to")).groupBy("n").agg(F.array_sort(F.collect_list(F.struct("at", "to"))).alias("masks"))
    of_id, of_hash, masked = fresh(docs, "secret_id", "secret_hash", "secret_masks")
    masks = rows.join(masks, "n").select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash), F.col("masks").alias(masked))
    masks = cut(masks.dropDuplicates([of_id, of_hash]).withColumnRenamed(of_hash, f"{of_hash}_"), "secrets-found")  # equal for equal texts of one id

    text, span = F.col(text_col), F.col(masked)
    def cleaned(chunk: Column, i: Column) -> Column:
        lo = i * CHUNK
        return F.aggregate(
            F.filter(span, lambda s: (s["at"] < lo + CHUNK) & (s["to"] > lo)),
            F.struct(F.lit(0).alias("end"), F.lit("").alias("out")),
            lambda acc, s: F.struct(
                F.least(s["to"] - lo, F.lit(CHUNK)).alias("end"),
                F.concat(acc["out"], F.substring(chunk, acc["end"] + 1, F.greatest(s["at"] - lo, F.lit(0)) - acc["end"]), F.when(s["at"] >= lo, F.lit(mask)).otherwise("")).alias("out"),
            ),
            lambda acc: F.concat(acc["out"], F.substring(chunk, acc["end"] + 1, F.lit(CHUNK))),
        )

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    clean = F.when(span.isNull(), text).otherwise(F.array_join(F.transform(pieces, cleaned), ""))
    def met(own: DataFrame, masks: DataFrame) -> DataFrame:
        own = own.withColumn(of_hash, F.xxhash64(text))
        own = own.join(masks, F.col(id_col).eqNullSafe(F.col(of_id)) & (F.col(of_hash) == F.col(f"{of_hash}_")), "left").withColumn(text_col, clean)
        if length_col in docs.columns:
            own = own.withColumn(length_col, F.when(span.isNull(), F.col(length_col)).otherwise(F.length(text)).cast(docs.schema[length_col].dataType))
        return own.select(*docs.columns)

    if (masks.agg(F.sum(F.size(masked))).first()[0] or 0) <= SENT_SPANS:
        return met(docs, F.broadcast(masks))
    some = F.lit(False)
    for kind, pattern, _, _ in (*RULES, ("live", TOKEN, 0, 20)):
        some = some | text.rlike(FASTER.get(kind, pattern))
    some = F.coalesce(some, F.lit(False))
    return docs.filter(~some).unionByName(met(docs.filter(some), masks))


def oracle_sql(max_owners: int = 2, max_repositories: int = 10) -> str:
    """DuckDB's SQL for :func:`report` of :func:`scan` over ``documents``; doc_id must be unique there."""
    patterns = {kind: (pattern, group, least) for kind, pattern, group, least in RULES} | {"live": ("[A-Za-z0-9+/_=-]+", 0, 20)}
    found = " UNION ALL ".join(
        f"SELECT doc_id, {KINDS.index(kind)} AS k, '{kind}' AS kind, {least} AS least, string_split_regex(text, {quoted}) AS gaps, "
        f"regexp_extract_all(text, {quoted}) AS hits, regexp_extract_all(text, {quoted}, {group}) AS vals FROM d"
        for kind, (pattern, group, least) in patterns.items()
        for quoted in ["'" + pattern.replace("'", "''") + "'"]
    )
    return f"""
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
    m AS ({found}),
    e AS (SELECT doc_id, k, kind, least, unnest(range(len(hits))) AS i, unnest(gaps[:len(hits)]) AS gap, unnest(hits) AS hit, unnest(vals) AS val FROM m WHERE len(hits) > 0),
    p AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, k ORDER BY i) AS upto FROM e),
    s AS (SELECT doc_id, k, kind, val, (upto - length(hit))::BIGINT AS a, upto::BIGINT AS b FROM p
          WHERE length(val) >= least AND (kind <> 'live' OR (regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]')))),
    c AS (SELECT * FROM s WHERE kind <> 'live' OR NOT EXISTS (SELECT 1 FROM s r WHERE r.doc_id = s.doc_id AND r.kind <> 'live' AND r.a < s.b AND s.a < r.b)),
    o AS (SELECT val, count(DISTINCT coalesce('s' || source, 'n')) AS owners, count(DISTINCT doc_id) AS repos FROM c JOIN d USING (doc_id) GROUP BY val),
    j AS (SELECT c.*, owners <= {max_owners} AND repos <= {max_repositories} AS live FROM c JOIN o USING (val)),
    t AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
            string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (kind <> 'live') AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans,
            count(*) FILTER (NOT live) AS n_example, count(*) FILTER (live) AS n_live FROM j WHERE live OR kind <> 'live' GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
      coalesce(spans, '') AS spans, coalesce(n_example, 0) AS n_example, coalesce(n_live, 0) AS n_live FROM d LEFT JOIN t USING (doc_id)"""
