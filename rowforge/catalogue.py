"""The library's own queries over the driver's tables, each with its SQL.

Lines come from documents (DL: texts cut at line feeds), events and lineitem (EV, LI: comma-separated), conversations (CV:
quoted fields) and supplier (SU). ``pos`` is a row's place in the output.
"""

from __future__ import annotations

import io
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.scratch import forget_at_exit, shared_dir
from .plans.options import TextJob
from .plans.planner import Result, plan
from .sources.lines import LineFrame, from_column, from_files, from_table, staged
from .sources.sinks import write_parts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(name: str):
    return F.col(name).cast("decimal(18,2)")


def dl(spark, d) -> LineFrame:
    return from_column(_read(spark, d, "documents"), "text", ["doc_id"])


def ev(spark, d) -> LineFrame:
    return from_table(_read(spark, d, "events"), [F.col("event_id"), F.col("user_id"), F.col("event_type"), _money("value")], ",", ["event_id"], unique=True)


def li(spark, d) -> LineFrame:
    columns = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_linestatus"), _money("l_quantity"), _money("l_extendedprice")]
    return from_table(_read(spark, d, "lineitem"), columns, ",", ["l_orderkey", "l_linenumber"])


def cv(spark, d) -> LineFrame:
    text = F.concat(F.lit('"'), F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit('""')), F.lit('"'))
    return from_table(_read(spark, d, "conversations"), [F.col("conv_id"), F.col("turn"), F.col("role"), text], ",", ["conv_id", "turn"], unique=True)


def su(spark, d) -> LineFrame:
    return from_table(_read(spark, d, "supplier"), [F.col("s_suppkey"), F.col("s_name"), F.col("s_nationkey"), _money("s_acctbal")], ";", ["s_suppkey"], unique=True)


def files(spark, d) -> LineFrame:
    """The lines of EV written as text files, in order by name, and read again."""
    at = f"{shared_dir(spark)}/rowforge/catalogue-{uuid.uuid4().hex}"
    forget_at_exit(spark, at)
    write_parts(plan(TextJob(), ev(spark, d)), at)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(at)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return from_files(spark, sorted(x for x in (f.getPath().toString() for f in found) if "/part-" in x))


def joined_files(spark, d) -> LineFrame:
    """Two files of a few lines each, the first without a line feed at its end, the second with CR LF."""
    rows = _read(spark, d, "region").orderBy("r_regionkey").collect()  # 5 rows at every size
    first = "\n".join(f"{r.r_regionkey},{r.r_name}" for r in rows)
    second = "".join(f"{r.r_name};{r.r_regionkey}\r\n" for r in rows)
    return from_files(spark, [staged(spark, io.BytesIO(x.encode())) for x in (first, second)])


TABLES = {
    "joined_files": """joined_files AS (SELECT row_number() OVER (ORDER BY f, i) AS row_no, content FROM (
        SELECT 0 AS f, r_regionkey AS i, r_regionkey || ',' || r_name AS content FROM region WHERE r_regionkey < (SELECT max(r_regionkey) FROM region)
        UNION ALL SELECT 1, 0, (SELECT max_by(r_regionkey || ',' || r_name, r_regionkey) FROM region) || (SELECT min_by(r_name || ';' || r_regionkey, r_regionkey) FROM region)
        UNION ALL SELECT 2, r_regionkey, r_name || ';' || r_regionkey FROM region WHERE r_regionkey > (SELECT min(r_regionkey) FROM region)))""",
    "dl": "dl AS (SELECT row_number() OVER (ORDER BY doc_id, i) AS row_no, content FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))",
    "ev": "ev AS (SELECT row_number() OVER (ORDER BY event_id) AS row_no, event_id || ',' || user_id || ',' || event_type || ',' || value::DECIMAL(18,2) AS content FROM events)",
    "li": "li AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, content) AS row_no, content FROM (SELECT l_orderkey, l_linenumber, l_orderkey || ',' || l_linenumber || ',' || l_returnflag || ',' || l_linestatus || ',' || l_quantity::DECIMAL(18,2) || ',' || l_extendedprice::DECIMAL(18,2) AS content FROM lineitem))",
    "cv": """cv AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS row_no, conv_id || ',' || turn || ',' || role || ',"' || replace(replace(text, chr(10), ' '), '"', '""') || '"' AS content FROM conversations)""",
    "su": "su AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS row_no, s_suppkey || ';' || s_name || ';' || s_nationkey || ';' || s_acctbal::DECIMAL(18,2) AS content FROM supplier)",
}
TABLES["files"] = TABLES["ev"]
SOURCES = {"dl": dl, "ev": ev, "li": li, "cv": cv, "su": su, "files": files, "joined_files": joined_files}


def add(name: str, lines: str, sql: str | None, table=None, **options) -> None:
    """A query: the job of ``options`` over a source; ``sql`` follows the source's common table expression."""
    job = TextJob(**options)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = plan(job, SOURCES[lines](spark, sf_dir))
        return (table or Result.to_table)(result)

    query.__name__ = name
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = f"WITH {TABLES[lines]} {sql}"


def rows_sql(lines: str, content: str = "content", where: str = "true", order: str = "row_no") -> str:
    return f"SELECT row_number() OVER (ORDER BY {order}) AS pos, {content} AS content FROM {lines} WHERE {where}"


F_ = "string_split(content, ',')"
#: The grammar of numbers, for DuckDB.
NUM = "CASE WHEN regexp_full_match({0}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST({0} AS DOUBLE) END"

# files
add("file_lines", "files", rows_sql("ev"))
add("file_rows_grep", "files", rows_sql("ev", where="row_no BETWEEN 100 AND 900 AND regexp_matches(content, '7')"), grep="7", rows="100-900")
add("file_end_relative", "files", rows_sql("ev", where="row_no > (SELECT count(*) FROM ev) - 10"), rows="~10-~1")
add("file_concat_bytes", "joined_files", rows_sql("joined_files"))
add("file_concat_sort", "joined_files", rows_sql("joined_files", order="content, row_no"), sort=True)
# rows
add("rows_range", "dl", rows_sql("dl", where="row_no BETWEEN 20 AND 500"), rows="20-500")
add("rows_list", "dl", rows_sql("dl", where="row_no BETWEEN 5 AND 30 OR row_no BETWEEN 40 AND 50 OR row_no = 3"), rows="40-50,5-20,15-30,3")
add("rows_open_head", "dl", rows_sql("dl", where="row_no <= 100"), rows="-100")
add("rows_open_tail", "dl", rows_sql("dl", where="row_no >= 1000"), rows="1000-")
add("rows_end_relative", "ev", rows_sql("ev", where="row_no > (SELECT count(*) FROM ev) - 10"), rows="~10-~1")
add("rows_mixed_bounds", "ev", rows_sql("ev", where="row_no >= 2 AND row_no < (SELECT count(*) FROM ev)"), rows="2-~2")
add("rows_delete", "dl", rows_sql("dl", where="row_no NOT BETWEEN 10 AND 2000"), delete=True, rows="10-2000")
add("rows_delete_grep", "dl", rows_sql("dl", where="NOT regexp_matches(content, '[0-9]')"), delete=True, grep="[0-9]")
# columns
add("cols_chars", "dl", rows_sql("dl", "substring(content, 1, 8)"), cols="1-8")
add("cols_chars_list", "dl", rows_sql("dl", "substring(content, 5, 2) || substring(content, 1, 2) || substring(content, 9)"), cols="5-6,1-2,9-")
add("fields_select", "ev", rows_sql("ev", f"{F_}[3]"), fields=",", cols="3")
add("fields_permute", "ev", rows_sql("ev", f"{F_}[3] || ',' || {F_}[1] || ',' || {F_}[2]"), fields=",", cols="3,1,2")
add("fields_range_outdelim", "ev", rows_sql("ev", f"{F_}[2] || ',' || {F_}[3] || '; ' || {F_}[1]"), fields=",", cols="2-3,1", output_delimiter="; ")
add("fields_missing_dropped", "dl", rows_sql("dl", "array_to_string(list_filter([string_split(content, '. ')[4], string_split(content, '. ')[1], string_split(content, '. ')[2]], lambda x: x IS NOT NULL), '. ')"), fields=". ", cols="4,1,2")
add("fields_multichar", "dl", rows_sql("dl", "coalesce(string_split(content, ', ')[2], '')"), fields=", ", cols="2")
QUOTED = """regexp_extract_all(',' || content, ',((?:[^",]|"[^"]*(?:"|$))*)', 1)"""
add("fields_quoted", "cv", rows_sql("cv", f"{QUOTED}[4]"), fields=",", quoted=True, cols="4")
add("fields_quoted_permute", "cv", rows_sql("cv", f"{QUOTED}[4] || ',' || {QUOTED}[3]"), fields=",", quoted=True, cols="4,3")
add("cols_delete_chars", "dl", rows_sql("dl", "substring(content, 1, 3) || substring(content, 7)"), delete=True, cols="4-6")
add("cols_delete_fields", "ev", rows_sql("ev", f"{F_}[2] || ',' || {F_}[4]"), delete=True, fields=",", cols="1,3")
add("cols_delete_rows_scoped", "ev", rows_sql("ev", f"CASE WHEN row_no BETWEEN 10 AND 50 THEN {F_}[1] || ',' || {F_}[3] || ',' || {F_}[4] ELSE content END"), delete=True, fields=",", cols="2", rows="10-50")
# filters
add("grep", "dl", rows_sql("dl", where="regexp_matches(content, '\\bthe\\b')"), grep=r"\bthe\b", cols=None)
add("grep_invert", "dl", rows_sql("dl", where="NOT regexp_matches(content, 'th[ae]')"), grep="th[ae]", invert=True)
add("grep_ignore_case", "dl", rows_sql("dl", where="regexp_matches(content, '^the ', 'i')"), grep="^the ", ignore_case=True)
add("grep_field", "ev", rows_sql("ev", where=f"regexp_matches({F_}[3], '^p')"), grep="^p", fields=",", cols="3")
add("grep_rows", "ev", rows_sql("ev", where="row_no BETWEEN 100 AND 900 AND regexp_matches(content, '7')"), grep="7", rows="100-900")
add("grep_exists", "dl", "SELECT EXISTS (SELECT 1 FROM dl WHERE regexp_matches(content, 'password')) AS matched", table=lambda r: r.matched.limit(1).agg((F.count("*") > 0).alias("matched")), grep="password", quiet=True)
# text
add("replace_literal", "dl", rows_sql("dl", "replace(content, 'the', 'THE')"), find=("the",), replace=("THE",))
add("replace_pairs", "dl", rows_sql("dl", "replace(replace(content, 'an', 'on'), 'on', 'un')"), find=("an", "on"), replace=("on", "un"))
add("replace_scoped", "ev", rows_sql("ev", f"{F_}[1] || ',' || replace({F_}[2], '1', 'X') || ',' || {F_}[3] || ',' || {F_}[4]"), find=("1",), replace=("X",), fields=",", cols="2")
add("replace_ignore_case", "dl", rows_sql("dl", "regexp_replace(content, 'the', '$0', 'gi')"), find=("the",), replace=("$0",), ignore_case=True)
add("replace_regex", "dl", rows_sql("dl", "regexp_replace(content, '[aeiou]+', '_', 'g')"), find=("[aeiou]+",), replace=("_",), regex=True)
add("replace_regex_groups", "ev", rows_sql("ev", "regexp_replace(content, '([0-9]+),([0-9]+)', '\\2 \\1', 'g')"), find=("([0-9]+),(?P<user>[0-9]+)",), replace=("$user $1",), regex=True)
add("upper_scoped", "dl", rows_sql("dl", "upper(replace(substring(content, 1, 3), 'ß', 'ss')) || substring(content, 4)"), upper=True, cols="1-3")
add("lower_line", "dl", rows_sql("dl", "lower(content)"), lower=True)
WORDS = "regexp_extract_all(content, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+')"
add("title_case", "dl", rows_sql("dl", f"array_to_string(list_transform({WORDS}, lambda t: upper(replace(t[1], 'ß', 'ss')) || lower(t[2:])), '')"), title_case=True)
add("squeeze", "dl", rows_sql("dl", "regexp_replace(content, '\\s+', ' ', 'g')"), squeeze=True)
add("trim", "dl", rows_sql("dl", "regexp_replace(content, '^\\s+|\\s+$', '', 'g')"), trim=True)
add("split_rows", "dl", "SELECT row_number() OVER (ORDER BY row_no, i) AS pos, content FROM (SELECT row_no, unnest(string_split(content, '. ')) AS content, unnest(range(len(string_split(content, '. ')))) AS i FROM dl)", split_on=". ")
WRAPPED = "SELECT row_no, unnest(list_transform(range(greatest(ceil(length(content) / 40.0)::BIGINT, 1)), lambda i: substring(content, (i * 40 + 1)::BIGINT, 40))) AS content, unnest(range(greatest(ceil(length(content) / 40.0)::BIGINT, 1))) AS i FROM dl"
add("wrap_rows", "dl", f"SELECT row_number() OVER (ORDER BY row_no, i) AS pos, content FROM ({WRAPPED})", wrap=40)
add("drop_empty", "dl", rows_sql("dl", where="content <> ''"), drop_empty=True)
add("trim_drop_empty", "dl", rows_sql("dl", "regexp_replace(content, '^\\s+|\\s+$', '', 'g')", "regexp_replace(content, '^\\s+|\\s+$', '', 'g') <> ''"), trim=True, drop_empty=True)
add("number_rows", "dl", "SELECT row_number() OVER (ORDER BY row_no) AS pos, row_number() OVER (ORDER BY row_no) || chr(9) || content AS content FROM dl WHERE regexp_matches(content, 'and')", number=True, grep="and")
PIPE = "SELECT row_no, i, p FROM (SELECT row_no, unnest(string_split(regexp_replace(content, '\\s+', ' ', 'g'), ',')) AS p, unnest(range(len(string_split(content, ',')))) AS i FROM dl) WHERE p <> ''"
add("pipeline_order", "dl", f"SELECT row_number() OVER (ORDER BY row_no, i) AS pos, row_number() OVER (ORDER BY row_no, i) || chr(9) || p AS content FROM ({PIPE})", squeeze=True, split_on=",", drop_empty=True, number=True)
# order
V4 = f"{F_}[4]::DOUBLE"
add("sort_lex", "dl", rows_sql("dl", order="content, row_no"), sort=True)
add("sort_numeric", "ev", rows_sql("ev", order=f"{V4}, row_no"), sort=True, numeric=True, fields=",", cols="4")
add("sort_reverse", "ev", rows_sql("ev", order=f"{V4} DESC, row_no"), sort=True, numeric=True, reverse=True, fields=",", cols="4")
add("sort_key_fields", "ev", rows_sql("ev", order=f"{F_}[3], row_no"), sort=True, sort_key="3", fields=",")
add("tac", "dl", rows_sql("dl", order="row_no DESC"), tac=True)
add("shuffle", "ev", "SELECT content FROM ev", table=lambda r: r.to_text().select("content"), shuffle=True)
RUN = "SELECT *, substring(content, 4) AS cut, row_no BETWEEN 20 AND 300 OR row_no BETWEEN 500 AND 900 AS e FROM ev"
add("sort_segments", "ev", f"SELECT row_number() OVER (ORDER BY g, e, CASE WHEN e THEN cut END, row_no) AS pos, CASE WHEN e THEN cut ELSE content END AS content FROM (SELECT *, sum(CASE WHEN e THEN 0 ELSE 1 END) OVER (ORDER BY row_no) AS g FROM ({RUN}))", delete=True, cols="1-3", sort=True, sort_key="1-200", rows="20-300,500-900")
# distinct
add("unique_line", "dl", "SELECT row_number() OVER (ORDER BY r) AS pos, content FROM (SELECT min(row_no) AS r, content FROM dl GROUP BY content)", unique=True)
add("unique_key", "ev", f"SELECT row_number() OVER (ORDER BY row_no) AS pos, content FROM (SELECT *, row_number() OVER (PARTITION BY {F_}[2] ORDER BY row_no) AS n FROM ev) WHERE n = 1", unique=True, unique_key="2", fields=",")
add("sort_unique", "dl", "SELECT row_number() OVER (ORDER BY content) AS pos, content FROM (SELECT DISTINCT content FROM dl)", sort=True, unique=True)
add("count_distinct", "dl", "SELECT count(DISTINCT content) AS count FROM dl", unique=True, count=True)
# summaries
add("count_all", "li", "SELECT count(*) AS count FROM li", count=True)
add("count_grep", "dl", "SELECT count(*) AS count FROM dl WHERE regexp_matches(content, '[0-9]')", count=True, grep="[0-9]")
add("count_zero", "dl", "SELECT count(*) AS count FROM dl WHERE content = 'no such line at all'", count=True, grep="^no such line at all$")


def rounded(result: Result) -> DataFrame:
    """Averages and sums to 4 places: their last digits depend on the order of addition."""
    table = result.to_table()
    return table.select(*[F.round(c, 4).alias(c) if c in ("sum", "avg") else F.col(c) for c in table.columns])


def groups_sql(lines: str, key: str, value: str, order: str = "min(row_no)") -> str:
    return f"SELECT row_number() OVER (ORDER BY {order}) AS pos, {key} AS key, count(*) AS count, round(coalesce(sum({value}), 0), 4) AS sum, round(avg({value}), 4) AS avg, min({value}) AS min, max({value}) AS max FROM {lines} GROUP BY {key}"


STATS = {"count": True, "sum": "4", "avg": "4", "min": "4", "max": "4", "fields": ","}
add("group_stats", "ev", groups_sql("ev", f"{F_}[3]", V4), table=rounded, group_by="3", **STATS)
add("group_first_seen", "ev", f"SELECT row_number() OVER (ORDER BY min(row_no)) AS pos, {F_}[2] AS key, count(*) AS count FROM ev GROUP BY {F_}[2]", group_by="2", count=True, fields=",")
add("group_multi_key", "li", f"SELECT row_number() OVER (ORDER BY min(row_no)) AS pos, {F_}[4] || '|' || {F_}[3] AS key, count(*) AS count, round(sum({F_}[5]::DOUBLE), 4) AS sum, max({F_}[6]::DOUBLE) AS max FROM li GROUP BY 2", table=rounded, group_by="4,3", count=True, sum="5", max="6", fields=",", output_delimiter="|")
add("sorted_groups", "ev", f"SELECT row_number() OVER (ORDER BY {F_}[3]) AS pos, {F_}[3] AS key, count(*) AS count FROM ev GROUP BY {F_}[3]", sort=True, sort_key="3", group_by="3", count=True, fields=",")
SPLIT3 = "string_split(content, ' ')[3]"
add("stats_skip_non_numeric", "dl", f"SELECT count(*) AS count, round(coalesce(sum({NUM.format(SPLIT3)}), 0), 4) AS sum, min({NUM.format(SPLIT3)}) AS min FROM dl", table=rounded, count=True, sum="3", min="3", fields=" ")
add("stats_no_numbers", "ev", f"SELECT 0.0::DOUBLE AS sum, NULL::DOUBLE AS avg, NULL::DOUBLE AS min FROM ev LIMIT 1", sum="3", avg="3", min="3", fields=",")
add("join_rows", "su", "SELECT 1::BIGINT AS pos, string_agg(content, ' / ' ORDER BY row_no) AS content FROM su", join=" / ")
add("sort_join", "su", "SELECT 1::BIGINT AS pos, string_agg(content, '|' ORDER BY string_split(content, ';')[4]::DOUBLE, row_no) AS content FROM su", sort=True, sort_key="4", numeric=True, fields=";", join="|")


def multi_file_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inputs in a row, numbered through."""
    a = _read(spark, sf_dir, "region").select(F.lit(0).alias("f"), F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    b = _read(spark, sf_dir, "nation").select(F.lit(1).alias("f"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    lines = from_table(a.unionByName(b), [F.col("k"), F.col("name")], ",", ["f", "k"], unique=True)
    return plan(TextJob(), lines).to_table()


QUERIES["multi_file_concat"] = multi_file_concat
ORACLES["multi_file_concat"] = "SELECT row_number() OVER (ORDER BY f, k) AS pos, k || ',' || name AS content FROM (SELECT 0 AS f, r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation)"
