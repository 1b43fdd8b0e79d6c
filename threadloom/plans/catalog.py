"""The query catalogue: each operator over the driver's tables, beside the SQL that has to agree with it.

`conversations` is the message table. It is plain, so Markdown, labels and duplicates are added by expressions that
mean the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions import names, pytext
from ..operators import batches, diff, mapping, messages, parts, render, turns
from ..schema import make_message
from ..sources import export_md, files, flat_json, tree_json

_SENDER = "CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'assistant' ELSE 'system' END"
_MD = """CASE (conv_id * 7 + turn) % 6
  WHEN 0 THEN concat('pcp_', cast(conv_id % 900 + 100 AS string), ' ', text)
  WHEN 1 THEN concat(text, chr(10), '# Head ', cast(turn AS string), chr(10), '#### Deep', chr(10), '## ')
  WHEN 2 THEN concat(text, chr(10), '```', chr(10), '# in code', chr(10), 'x', chr(10), 'y', chr(10), 'z', chr(10), '```', chr(10), '# out')
  WHEN 3 THEN concat(text, chr(10), '```', chr(10), 'This block is not supported on your current device yet.', chr(10), '```', chr(10), 'tail')
  WHEN 4 THEN concat(text, ' $$ x + y $$ and $$z$$', chr(10), chr(10), chr(10), chr(10), 'gap')
  ELSE concat(text, chr(10), '---', chr(10), 'after') END"""
_MESSAGES = f"SELECT conv_id, turn AS idx, {_SENDER} AS sender, text, concat('m', cast(conv_id AS string), '-', cast(turn AS string)) AS uuid FROM conversations"
_RICH = f"SELECT conv_id, turn AS idx, {_SENDER} AS sender, {_MD} AS text FROM conversations UNION ALL SELECT conv_id, turn + 1000 AS idx, {_SENDER} AS sender, {_MD} AS text FROM conversations WHERE turn <= 2 AND conv_id % 4 = 0"
_NAMES = "SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN '' ELSE concat('Chat ', cast(conv_id AS string)) END AS name FROM conversations GROUP BY conv_id"


def _view(spark: SparkSession, sf_dir: str, sql: str, **tables: str) -> DataFrame:
    """A SELECT of both engines over the driver's table, as Spark runs it."""
    got = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("conversations", "documents") if t in sql}
    text = sql
    for t in got:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **got)


def _msgs(spark, sf_dir, sql=_MESSAGES):
    return _view(spark, sf_dir, sql).withColumnRenamed("idx", "index").withColumn("render_kind", F.lit("text"))


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_TURN = f"m AS ({_MESSAGES}), r AS ({_RICH}), names AS ({_NAMES})"
_PAIRS = """t AS (SELECT *, sum(CASE sender WHEN 'human' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx ROWS UNBOUNDED PRECEDING)::BIGINT AS turn FROM r),
p AS (SELECT conv_id, turn, min_by(text, idx) FILTER (sender = 'human') AS prompt, min_by(text, idx) FILTER (sender = 'assistant') AS completion FROM t WHERE turn > 0 GROUP BY ALL)"""
_DEDUPED = f"""d AS (SELECT conv_id, turn, prompt, completion FROM p WHERE {_STRIP.format("coalesce(prompt, '')")} <> '' OR {_STRIP.format("coalesce(completion, '')")} <> ''
QUALIFY row_number() OVER (PARTITION BY conv_id, {_STRIP.format("coalesce(prompt, '')")}, {_STRIP.format("coalesce(completion, '')")} ORDER BY turn) = 1)"""
_LABELLED = r"""own AS (SELECT *, nullif(regexp_extract(prompt, '(?i)pcp_((?:\d{3}_)*\d{3})', 1), '') AS o FROM d),
l AS (SELECT conv_id, turn, prompt, completion, coalesce(o, printf('%03d', (sum(CASE WHEN o IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1)::BIGINT)) AS label FROM own)"""
_RSTRIP = r"regexp_replace({}, '\s+$', '')"
_RENDERED = f"""b AS (SELECT conv_id, string_agg('## pcp_' || label || chr(10) || chr(10) || '**A Prompt by User**' || chr(10) || chr(10) || {_RSTRIP.format("coalesce(prompt, '')")} || chr(10) || chr(10) || '**A Completion by LLM**' || chr(10) || chr(10) || {_RSTRIP.format("coalesce(completion, '')")} || chr(10) || chr(10) || '---' || chr(10) || chr(10), '' ORDER BY turn) AS body FROM l GROUP BY conv_id),
md0 AS (SELECT conv_id, coalesce(nullif(CASE WHEN name <> '' THEN '# ' || name || chr(10) || chr(10) ELSE '' END || coalesce(body, ''), ''), chr(10)) AS md FROM names LEFT JOIN b USING (conv_id))"""
_ALL = f"WITH {_TURN}, {_PAIRS}, {_DEDUPED}, {_LABELLED}, {_RENDERED}"


def _lines(source: str, key: str, text: str, name: str = "ln") -> str:
    """CTEs with the lines of a text: position from 0, without a last empty one."""
    return f"{name}0 AS (SELECT {key}, {text} AS v, string_split({text}, chr(10)) AS a FROM {source}), {name} AS (SELECT {key}, unnest(CASE WHEN v LIKE '%' || chr(10) OR v = '' THEN a[1:-2] ELSE a END) AS x, generate_subscripts(CASE WHEN v LIKE '%' || chr(10) OR v = '' THEN a[1:-2] ELSE a END, 1) - 1 AS i FROM {name}0)"


def _unsupported(source: str, key: str, text: str, out: str) -> str:
    """CTEs `{out}`(key, text, removed): texts without unsupported blocks."""
    k = key
    return f"""{_lines(source, k, text, out + "_l")},
{out}_f AS (SELECT *, regexp_matches(x, '^\\s*```') AS fence FROM {out}_l),
{out}_g AS (SELECT *, sum(fence::INT) OVER (PARTITION BY {k} ORDER BY i ROWS UNBOUNDED PRECEDING) AS n FROM {out}_f),
{out}_h AS (SELECT *, CASE WHEN n % 2 = 1 OR fence THEN (n + 1) // 2 END AS blk FROM {out}_g),
{out}_b AS (SELECT {k}, blk, count(*) FILTER (NOT fence) <= 3 AND bool_or(NOT fence AND contains(x, 'This block is not supported')) AS gone FROM {out}_h WHERE blk IS NOT NULL GROUP BY {k}, blk),
{out}_n AS (SELECT {k}, count(*) FILTER (gone) AS removed FROM {out}_b GROUP BY {k}),
{out}_t AS (SELECT {k}, string_agg(x, chr(10) ORDER BY i) FILTER (NOT coalesce(gone, false)) AS t FROM {out}_h LEFT JOIN {out}_b USING ({k}, blk) GROUP BY {k}),
{out} AS (SELECT s.{k} AS {k}, coalesce(t, '') AS text, coalesce(removed, 0) AS removed FROM {source} s LEFT JOIN {out}_t USING ({k}) LEFT JOIN {out}_n USING ({k}))"""


_MATH = r"regexp_replace(regexp_replace(regexp_replace({}, '\$\$((?s:.+?))\$\$', chr(64976) || '\1' || chr(64977), 'g'), chr(64976) || '\s*', '`', 'g'), '\s*' || chr(64977), '`', 'g')"
_COLLAPSE = r"regexp_replace({}, '\n{{3,}}', chr(10) || chr(10), 'g')"


def _rules(source: str, key: str, text: str, out: str) -> str:
    k = key
    blank = r"regexp_matches(coalesce({}, ''), '^\s*$')"
    rule = r"regexp_matches({}, '^\s*---\s*$')"
    return f"""{_lines(source, k, text, out + "_l")},
{out}_p AS (SELECT *, lag(x) OVER (PARTITION BY {k} ORDER BY i) AS b FROM {out}_l),
{out}_t AS (SELECT {k}, string_agg(CASE WHEN i > 0 AND NOT {blank.format("b")} AND NOT {blank.format("x")} AND ({rule.format("b")} OR {rule.format("x")}) THEN chr(10) ELSE '' END || x, chr(10) ORDER BY i) AS t FROM {out}_p GROUP BY {k}),
{out} AS (SELECT s.{k} AS {k}, coalesce(t, '') AS text FROM {source} s LEFT JOIN {out}_t USING ({k}))"""


def _cleaned(source: str, key: str, text: str) -> str:
    """CTE `c`(key, text, removed, converted)."""
    return f"""{_unsupported(source, key, text, "u")},
q AS (SELECT {key}, removed, len(regexp_extract_all(text, '(?s)\\$\\$.+?\\$\\$')) AS converted, {_COLLAPSE.format(_MATH.format("text"))} AS text FROM u),
{_rules("q", key, "text", "h")},
c AS (SELECT h.{key} AS {key}, {_RSTRIP.format(_COLLAPSE.format("h.text"))} || chr(10) AS text, removed, converted FROM h JOIN q USING ({key}))"""


@query(f"WITH {_TURN} SELECT conv_id, sender, CASE sender WHEN 'human' THEN 'user' ELSE sender END AS raw_role, 'text' AS render_kind, row_number() OVER (PARTITION BY conv_id ORDER BY idx) - 1 AS position, uuid, text FROM m")
def messages_normalized(spark, sf_dir):
    rows = messages.reindexed(_msgs(spark, sf_dir), "conv_id", "index")
    m = make_message(F.col("uuid"), F.col("sender"), F.col("text"), F.col("index"))
    rows = rows.select("conv_id", m.alias("m"))
    return rows.select("conv_id", "m.sender", "m.raw_role", "m.render_kind", F.col("m.index").cast("long").alias("position"), "m.uuid", "m.text")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN text || chr(10) || role ELSE text END AS visible FROM conversations")
def visible_text(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    two = F.array(block("text", F.col("text")), block("image", F.lit("x")), block("text", F.lit("")), block("text", F.col("role")))
    content = F.when(F.col("turn") % 3 == 0, F.array(block("text", F.col("text")))).when(F.col("turn") % 3 == 1, two)
    return rows.select("conv_id", "turn", messages.visible_text("text", content).alias("visible"))


_BLANKED = f"SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 OR turn % 4 = 3 THEN chr(10) || '  ' ELSE text END AS text FROM conversations"


@query(rf"WITH e AS ({_BLANKED}) SELECT conv_id, turn, regexp_matches(text, '^\s*$') AS is_empty FROM e")
def message_empty(spark, sf_dir):
    rows = _view(spark, sf_dir, _BLANKED)
    content = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    return rows.select("conv_id", "turn", messages.message_is_empty("text", content).alias("is_empty"))


@query(rf"WITH e AS ({_BLANKED}), g AS (SELECT conv_id, count(*) AS n_messages, count(*) FILTER (regexp_matches(text, '^\s*$')) AS n_empty FROM e GROUP BY 1) SELECT *, n_empty / n_messages AS empty_ratio, n_empty / n_messages >= 0.95 AS is_empty FROM g")
def empty_chat_stats(spark, sf_dir):
    return messages.empty_stats(_view(spark, sf_dir, _BLANKED), "conv_id")


@query(f"WITH {_TURN}, {_PAIRS} SELECT conv_id, idx AS position, turn FROM t")
def turn_ids(spark, sf_dir):
    return turns.with_turns(_msgs(spark, sf_dir, _RICH), "conv_id").select("conv_id", F.col("index").alias("position"), "turn")


_PIECES = "SELECT conv_id, turn * 10 + k AS idx, sender, CASE k WHEN 0 THEN text WHEN 1 THEN '  ' WHEN 2 THEN concat('more ', uuid) ELSE concat('call ', uuid) END AS text, CASE k WHEN 3 THEN 'code' ELSE 'text' END AS render_kind, k FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' ELSE role END AS sender, text, concat('m', cast(turn AS string)) AS uuid, explode_k AS k FROM (SELECT *, 0 AS explode_k FROM conversations UNION ALL SELECT *, 1 AS explode_k FROM conversations UNION ALL SELECT *, 2 AS explode_k FROM conversations UNION ALL SELECT *, 3 AS explode_k FROM conversations) y WHERE explode_k = 0 OR role = 'assistant') z"


@query(rf"""WITH r AS ({_PIECES}), t AS (SELECT *, sum(CASE sender WHEN 'human' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS turn FROM r),
e AS (SELECT *, sender = 'assistant' AND render_kind = 'text' AND NOT regexp_matches(text, '^\s*$') AND turn > 0 AS ok FROM t),
f AS (SELECT *, sum(ok::INT) OVER (PARTITION BY conv_id, turn ORDER BY idx ROWS UNBOUNDED PRECEDING) AS nth, string_agg(CASE WHEN ok THEN text END, chr(10) || chr(10)) OVER (PARTITION BY conv_id, turn ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS al FROM e)
SELECT conv_id, idx AS position, sender, render_kind, CASE WHEN ok THEN al ELSE text END AS text FROM f WHERE NOT ok OR nth = 1""")
def merge_assistant_texts(spark, sf_dir):
    rows = _view(spark, sf_dir, _PIECES).withColumnRenamed("idx", "index")
    return turns.merge_assistant_texts(rows, "conv_id").select("conv_id", F.col("index").alias("position"), "sender", "render_kind", "text")


@query(f"WITH {_TURN}, {_PAIRS} SELECT * FROM p")
def pair_turns(spark, sf_dir):
    return turns.pair_turns(_msgs(spark, sf_dir, _RICH), "conv_id")


def _deduped(spark, sf_dir):
    return turns.dedupe_pairs(turns.pair_turns(_msgs(spark, sf_dir, _RICH), "conv_id"), "conv_id")


@query(f"WITH {_TURN}, {_PAIRS}, {_DEDUPED} SELECT * FROM d")
def dedupe_pairs(spark, sf_dir):
    return _deduped(spark, sf_dir)


@query(f"WITH {_TURN}, {_PAIRS}, {_DEDUPED}, {_LABELLED} SELECT * FROM l")
def label_pairs(spark, sf_dir):
    return turns.label_pairs(_deduped(spark, sf_dir), "conv_id")


@query(f"""WITH {_TURN}, {_PAIRS}, {_DEDUPED}, {_LABELLED} SELECT conv_id, count(*) AS n_pairs, count(*) FILTER (completion IS NULL) AS n_open, min(label) AS first_label FROM l GROUP BY 1""")
def pairs_per_conversation(spark, sf_dir):
    rows = turns.label_pairs(_deduped(spark, sf_dir), "conv_id")
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("completion").isNull()).alias("n_open"), F.min("label").alias("first_label"))


_KEYED = f"r AS (SELECT conv_id * 10000 + idx AS id, text FROM ({_RICH}) y)"


def _texts(spark, sf_dir):
    return _msgs(spark, sf_dir, _RICH).select((F.col("conv_id") * 10000 + F.col("index")).alias("id"), "text")


@query(rf"""WITH {_KEYED}, {_lines("r", "id", "text")},
f AS (SELECT *, regexp_matches(x, '^\s*(```|~~~)') AS fence FROM ln), g AS (SELECT *, sum(fence::INT) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS n FROM f),
h AS (SELECT *, NOT fence AND n % 2 = 0 AND regexp_matches(x, '^#{{1,6}}[ \t]+') AS head, length(regexp_extract(x, '^(#+)', 1)) + 1 AS lv, regexp_extract(x, '^#+[ \t]+(.*)$', 1) AS ct FROM g)
SELECT id, string_agg(CASE WHEN NOT head THEN x WHEN lv <= 3 THEN repeat('#', lv) || ' ' || ct WHEN trim(ct) <> '' THEN '**' || trim(ct) || '**' ELSE '' END, chr(10) ORDER BY i) AS text FROM h GROUP BY id""")
def shift_headings(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", md.shift_headings("text").alias("text"))


def _rendered(spark, sf_dir, **options):
    rows = _msgs(spark, sf_dir, _RICH)
    return render.render(rows, _view(spark, sf_dir, _NAMES), "conv_id", **options)


@query(_ALL + " SELECT * FROM md0")
def render_markdown(spark, sf_dir):
    return _rendered(spark, sf_dir, safe=False)


@query(f"{_ALL}, {_cleaned('md0', 'conv_id', 'md')} SELECT conv_id, text AS md FROM c")
def render_clean_markdown(spark, sf_dir):
    return _rendered(spark, sf_dir)


@query(f"WITH {_KEYED}, {_unsupported('r', 'id', 'text', 'u')} SELECT id, text, removed FROM u")
def strip_unsupported(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", md.without_unsupported("text").alias("text"), md.count_unsupported("text").alias("removed"))


@query(rf"SELECT doc_id, {_MATH.format('text')} AS text, len(regexp_extract_all(text, '(?s)\$\$.+?\$\$')) AS converted FROM documents")
def math_to_code(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", md.math_to_code("text").alias("text"), md.count_block_math("text").alias("converted"))


@query(f"WITH {_KEYED} SELECT id, {_COLLAPSE.format('text')} AS text FROM r")
def collapse_blanks(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", md.collapse_blanks("text").alias("text"))


@query(f"WITH {_KEYED}, {_rules('r', 'id', 'text', 'h')} SELECT id, text FROM h")
def hr_spacing(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", md.space_rules("text").alias("text"))


@query(f"WITH {_KEYED}, {_cleaned('r', 'id', 'text')} SELECT id, text, removed, converted FROM c")
def clean_markdown(spark, sf_dir):
    rows = _texts(spark, sf_dir).select("id", md.cleaned("text").alias("c"))
    return rows.select("id", "c.text", F.col("c.unsupported_removed").alias("removed"), F.col("c.block_math_converted").alias("converted"))


@query(f"WITH {_KEYED}, {_cleaned('r', 'id', 'text')} SELECT count(*) AS files, sum(removed)::BIGINT AS unsupported_removed, sum(converted)::BIGINT AS block_math_converted FROM c")
def cleanup_stats(spark, sf_dir):
    return render.clean_totals(render.clean_all(_texts(spark, sf_dir), "id"))


_TITLES = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat(' a:b*c?', text) WHEN 1 THEN concat(substring(text, 1, 30), '... ') WHEN 2 THEN concat('__', substring(text, 1, 12), chr(9), chr(10), 'x\"y<z>|') WHEN 3 THEN '' ELSE text END AS title, lang, source, n_chars FROM documents"
_SANITIZE = r"""CASE WHEN coalesce({0}, '') = '' THEN 'untitled' ELSE coalesce(nullif(regexp_replace(substring(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({0}), '[/\\:*?"<>|\x00-\x1F\x7F]', '_', 'g'), '\s+', '_', 'g'), '_+', '_', 'g'), '[\s.]+$', ''), '^_+|_+$', '', 'g'), 1, 80), '_+$', ''), ''), 'untitled') END"""


@query(f"WITH t AS ({_TITLES}) SELECT doc_id, {_SANITIZE.format('title')} AS title FROM t")
def sanitize_titles(spark, sf_dir):
    return _view(spark, sf_dir, _TITLES).select("doc_id", names.sanitize_title("title").alias("title"))


_DATED = "SELECT conv_id, concat('Chat about ', cast(conv_id % 3 AS string)) AS name, CASE conv_id % 4 WHEN 0 THEN '' ELSE concat('c', cast(conv_id % 40 AS string), '-abcdefgh', cast(conv_id AS string)) END AS uuid, CASE WHEN conv_id % 5 = 0 THEN '2024-03-01_x.md' END AS orig, CASE conv_id % 3 WHEN 0 THEN '' WHEN 1 THEN '2025-01-02T03:04:05+00:00' ELSE '1734588000.5' END AS created_at, CASE WHEN conv_id % 2 = 0 THEN '2025-06-07' ELSE 'none' END AS updated_at FROM conversations GROUP BY conv_id"
_DAY = r"CASE WHEN regexp_matches(coalesce({0}, ''), '^\d{{4}}-\d{{2}}-\d{{2}}') THEN {0}[1:10] WHEN try_cast({0} AS DOUBLE) > 0 THEN strftime(to_timestamp(try_cast({0} AS DOUBLE)) AT TIME ZONE 'UTC', '%Y-%m-%d') END"
_PREFIX = f"coalesce(CASE WHEN orig IS NOT NULL THEN orig[1:10] END, {_DAY.format('created_at')}, {_DAY.format('updated_at')}, 'undated')"
_SHORT = "CASE WHEN coalesce({0}, '') = '' THEN 'noid' WHEN length(split_part({0}, '-', 1)) >= 8 THEN split_part({0}, '-', 1)[1:8] ELSE coalesce(nullif(replace({0}, '-', '')[1:8], ''), 'noid') END"
_STEM = f"{_PREFIX} || '__' || {_SANITIZE.format('name')} || '__' || {_SHORT.format('uuid')}"


def _dated(spark, sf_dir):
    return _view(spark, sf_dir, _DATED)


@query(f"WITH t AS ({_DATED}) SELECT conv_id, {_PREFIX} AS day FROM t")
def date_prefix(spark, sf_dir):
    return _dated(spark, sf_dir).select("conv_id", names.date_prefix(F.col("orig"), F.col("created_at"), F.col("updated_at")).alias("day"))


@query(f"WITH t AS ({_DATED}) SELECT conv_id, {_SHORT.format('uuid')} AS id8 FROM t")
def short_ids(spark, sf_dir):
    return _dated(spark, sf_dir).select("conv_id", names.short_id("uuid").alias("id8"))


def _stems(spark, sf_dir):
    source = F.struct(F.lit("x").alias("platform"), F.col("orig").alias("original_filename"))
    rows = _dated(spark, sf_dir).withColumn("source", source).withColumn("conv_ord", F.col("conv_id"))
    return mapping.with_stems(rows, any_unicode=False)


@query(f"WITH t AS ({_DATED}) SELECT conv_id, {_STEM} || '.md' AS file_name, printf('%04d_', conv_id) || coalesce(nullif(uuid, ''), 'noid') AS old_stem FROM t")
def readable_names(spark, sf_dir):
    return _stems(spark, sf_dir).select("conv_id", F.concat("stem", F.lit(".md")).alias("file_name"), "old_stem")


_FILE_NAMES = "SELECT conv_id, concat(CASE conv_id % 3 WHEN 0 THEN concat('0012_0a1b2c3d-', cast(conv_id AS string)) WHEN 1 THEN '2025-01-02__t__0a1b2c3d' ELSE '0012_0a1b2c' END, '.md') AS file_name FROM conversations GROUP BY conv_id"


@query(rf"WITH t AS ({_FILE_NAMES}) SELECT conv_id, regexp_matches(regexp_replace(file_name, '\.[^.]*$', ''), '^[0-9]{{4}}_[\-a-f0-9]{{8,}}$') AS legacy FROM t")
def legacy_names(spark, sf_dir):
    return _view(spark, sf_dir, _FILE_NAMES).select("conv_id", names.is_legacy("file_name").alias("legacy"))


_RESOLVED = f"""t AS ({_DATED}), s AS (SELECT *, {_STEM} AS stem, CASE WHEN uuid = '' THEN '#' || conv_id ELSE '=' || uuid END AS who FROM t),
w AS (SELECT *, min(conv_id) OVER (PARTITION BY stem, who) AS f FROM s), k AS (SELECT *, dense_rank() OVER (PARTITION BY stem ORDER BY f) AS k FROM w),
z AS (SELECT *, CASE WHEN k > 1 THEN stem || '_' || k ELSE stem END AS final_stem FROM k)"""


@query(f"WITH {_RESOLVED} SELECT conv_id, final_stem, k - 1 AS n_collisions FROM z")
def name_collisions(spark, sf_dir):
    return mapping.resolved(_stems(spark, sf_dir)).select("conv_id", "final_stem", "n_collisions")


_MAPPED = "SELECT conv_id AS ord, uuid AS conv_id, name AS title, created_at, printf('%04d_', conv_id) || coalesce(nullif(uuid, ''), 'noid') || '.md' AS old_filename, final_stem || '.md' AS new_filename FROM z"


@query(f"WITH {_RESOLVED} {_MAPPED}")
def filename_mapping(spark, sf_dir):
    return mapping.mapping(mapping.resolved(_stems(spark, sf_dir))).withColumnRenamed("conv_ord", "ord")


@query(f"""WITH {_RESOLVED}, mp AS ({_MAPPED}), old AS (SELECT * FROM mp WHERE ord % 3 <> 0 AND conv_id <> ''), new AS (SELECT * REPLACE ('new ' || title AS title) FROM mp WHERE ord % 2 = 0 AND conv_id <> ''),
u AS (SELECT * FROM new UNION ALL SELECT * FROM old WHERE conv_id NOT IN (SELECT conv_id FROM new))
SELECT conv_id, title, created_at, old_filename, new_filename, ord % 5 = 0 AS orphan FROM u""")
def mapping_upsert(spark, sf_dir):
    rows = mapping.mapping(mapping.resolved(_stems(spark, sf_dir)))
    old = rows.where("conv_ord % 3 <> 0").withColumnRenamed("conv_ord", "ord")
    new = rows.where("conv_ord % 2 = 0").withColumn("title", F.concat(F.lit("new "), "title"))
    current = rows.where("conv_ord % 5 <> 0").select("conv_ord", F.col("conv_id").alias("uuid"))
    return mapping.upserted(old, new, current).select(*mapping.COLUMNS, F.col("place.orphan").alias("orphan"))


_STALE = "f AS (SELECT new_filename AS file_name FROM mp UNION ALL SELECT 'old__' || {0} || '.md' FROM mp WHERE ord % 6 = 1)".format(_SHORT.format("conv_id"))


@query(f"""WITH {_RESOLVED}, mp AS ({_MAPPED}), {_STALE}, ch AS (SELECT {_SHORT.format('conv_id')} AS id8, new_filename FROM mp WHERE ord % 6 = 1)
SELECT DISTINCT file_name FROM f JOIN ch ON regexp_extract(regexp_replace(file_name, '\\.md$', ''), '__([^_]+)$', 1) = id8 WHERE file_name <> new_filename""")
def stale_names(spark, sf_dir):
    rows = mapping.mapping(mapping.resolved(_stems(spark, sf_dir)))
    changed = rows.where("conv_ord % 6 = 1")
    more = changed.select(F.concat(F.lit("old__"), names.short_id("conv_id"), F.lit(".md")).alias("file_name"))
    return mapping.stale(rows.select(F.col("new_filename").alias("file_name")).unionByName(more), changed.select(F.col("conv_id").alias("uuid"), "new_filename"))


_BOUND = r"'^(?:- |#+[ \t]+)pcp_((?:\d{3}_)*\d{3})\s*$'"
_BLOCKS = rf"""{_lines("md0", "conv_id", "md")}, bl AS (SELECT *, nullif(regexp_extract(x, {_BOUND}, 1), '') AS lb FROM ln),
bk AS (SELECT *, sum((lb IS NOT NULL)::INT) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS blk FROM bl)"""


@query(f"{_ALL}, {_BLOCKS} SELECT conv_id, blk - 1 AS block_ord, max(lb) AS label, split_part(max(lb), '_', 1)::INTEGER AS first_num, count(*) AS n_lines FROM bk WHERE blk > 0 GROUP BY conv_id, blk")
def split_blocks(spark, sf_dir):
    rows = parts.blocks(_rendered(spark, sf_dir, safe=False).withColumnRenamed("md", "text"), "conv_id")
    return rows.withColumn("block_ord", F.col("block_ord").cast("long")).withColumn("n_lines", F.col("n_lines").cast("long"))


_PARTS = f"""{_BLOCKS},
bt AS (SELECT conv_id, blk, split_part(max(lb), '_', 1)::INTEGER AS num, string_agg(x, chr(10) ORDER BY i) || CASE WHEN last(x ORDER BY i) <> '' THEN chr(10) ELSE '' END AS t, (blk - 1) // 2 + 1 AS part FROM bk WHERE blk > 0 GROUP BY conv_id, blk),
hd AS (SELECT conv_id, {_RSTRIP.format("coalesce(string_agg(x, chr(10) ORDER BY i), '')")} AS h FROM bk WHERE blk = 0 GROUP BY conv_id),
pt AS (SELECT conv_id, part, min(num) AS lo, max(num) AS hi, count(*) AS n, string_agg(t, chr(10) ORDER BY blk) AS t, max(max(part)) OVER (PARTITION BY conv_id) AS np FROM bt GROUP BY conv_id, part),
sp AS (SELECT conv_id, part::INTEGER AS part, np::INTEGER AS n_parts, n::INTEGER AS n_blocks, printf('s%d__part%02d_pcp%03d-%03d.md', conv_id, part, lo, hi) AS file_name,
  {_RSTRIP.format("CASE WHEN coalesce(h, '') <> '' THEN h || chr(10) ELSE '' END || chr(10) || printf('_(part %d / %d : pcp_%03d ' || chr(12316) || ' pcp_%03d, %d pcps, source: s%d.md)_', part, np, lo, hi, n, conv_id) || chr(10) || chr(10) || t")} || chr(10) AS text FROM pt LEFT JOIN hd USING (conv_id)
 UNION ALL SELECT conv_id, 1, 1, 0, 's' || conv_id || '.md', md FROM md0 WHERE conv_id NOT IN (SELECT conv_id FROM bt))"""


def _split(spark, sf_dir):
    rows = _rendered(spark, sf_dir, safe=False)
    stem = F.concat(F.lit("s"), F.col("conv_id").cast("string"))
    return parts.split(rows.select("conv_id", stem.alias("stem"), F.concat(stem, F.lit(".md")).alias("src_name"), F.col("md").alias("text")), 2, "conv_id")


@query(f"{_ALL}, {_PARTS} SELECT conv_id, part, n_parts, n_blocks, file_name, text FROM sp")
def split_parts(spark, sf_dir):
    return _split(spark, sf_dir)


@query(f"{_ALL}, {_PARTS} SELECT conv_id, part, file_name FROM sp")
def part_names(spark, sf_dir):
    return _split(spark, sf_dir).select("conv_id", "part", "file_name")


_ORIG = r"coalesce(nullif(regexp_extract(regexp_replace({0}, '\.[^./]*$', ''), '^(.+?)__part[0-9]+_pcp[0-9]+-[0-9]+$', 1), ''), regexp_replace({0}, '\.[^./]*$', ''))"


@query(f"{_ALL}, {_PARTS} SELECT file_name, {_ORIG.format('file_name')} AS stem FROM sp")
def orig_stem(spark, sf_dir):
    return _split(spark, sf_dir).select("file_name", names.original_stem(F.col("file_name")).alias("stem"))


_GROUPS = f"gr AS (SELECT {_ORIG.format('file_name')} AS stem, string_agg(file_name, '|' ORDER BY file_name) AS files, count(*) AS n FROM sp GROUP BY 1)"


@query(f"{_ALL}, {_PARTS}, {_GROUPS} SELECT * FROM gr")
def group_by_stem(spark, sf_dir):
    return batches.group_by_stem(_split(spark, sf_dir).select("file_name")).withColumn("files", F.array_join("files", "|"))


_FOLD = """od AS (SELECT stem, n, row_number() OVER (ORDER BY stem) AS k FROM gr),
RECUR AS (SELECT 0::BIGINT AS k, 0::BIGINT AS fill, 1::BIGINT AS cur, 0::BIGINT AS batch_no
 UNION ALL SELECT o.k, CASE WHEN o.n > 3 THEN 0 WHEN r.fill > 0 AND r.fill + o.n > 3 THEN o.n ELSE r.fill + o.n END,
  CASE WHEN o.n > 3 THEN r.cur + (r.fill > 0)::INT + 1 WHEN r.fill > 0 AND r.fill + o.n > 3 THEN r.cur + 1 ELSE r.cur END,
  CASE WHEN o.n > 3 THEN r.cur + (r.fill > 0)::INT WHEN r.fill > 0 AND r.fill + o.n > 3 THEN r.cur + 1 ELSE r.cur END
 FROM RECUR r JOIN od o ON o.k = r.k + 1)"""
_BATCHES = (f"{_ALL}, {_PARTS}, {_GROUPS}, {_FOLD}").replace("WITH ", "WITH RECURSIVE ", 1)


def _packed(spark, sf_dir):
    groups = batches.group_by_stem(_split(spark, sf_dir).select("file_name"))
    return batches.pack(groups, 2, 1)


@query(f"{_BATCHES} SELECT stem, n, batch_no FROM RECUR JOIN od USING (k)")
def zip_batches(spark, sf_dir):
    return _packed(spark, sf_dir).select("stem", "n", "batch_no")


@query(f"""{_BATCHES}, fb AS (SELECT batch_no, stem, n FROM RECUR JOIN od USING (k)), sz AS (SELECT {_ORIG.format('file_name')} AS stem, sum(strlen(text)) AS b FROM sp GROUP BY 1),
iz AS (SELECT batch_no, sum(n)::BIGINT AS n_files, count(*) AS n_conversations, sum(b)::BIGINT AS total_bytes FROM fb JOIN sz USING (stem) GROUP BY 1)
SELECT batch_no, 'notion_md_batch_' || lpad(batch_no::VARCHAR, greatest(2, length((SELECT max(batch_no) FROM iz)::VARCHAR))::INTEGER, '0') || printf('_%03dfiles.zip', n_files) AS zip_name, n_files, n_conversations, total_bytes FROM iz""")
def zip_infos(spark, sf_dir):
    sizes = _split(spark, sf_dir).select("file_name", F.octet_length("text").cast("long").alias("size"))
    return batches.batch_infos(sizes, _packed(spark, sf_dir))


@query("SELECT doc_id, sha1(text) AS sha1 FROM documents")
def text_sha1(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", names.text_sha1("text").alias("sha1"))


_SIZES = "SELECT doc_id, n_chars * CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 10737418240 END AS bytes FROM documents"


@query(f"WITH t AS ({_SIZES}) SELECT doc_id, CASE WHEN bytes < 1024 THEN printf('%.1f B', bytes::DOUBLE) WHEN bytes < 1048576 THEN printf('%.1f KB', bytes / 1024) WHEN bytes < 1073741824 THEN printf('%.1f MB', bytes / 1048576) WHEN bytes < 1099511627776 THEN printf('%.1f GB', bytes / 1073741824) ELSE printf('%.1f TB', bytes / 1099511627776) END AS size FROM t")
def format_size(spark, sf_dir):
    return _view(spark, sf_dir, _SIZES).select("doc_id", names.format_size("bytes").alias("size"))


def _print(source: str) -> str:
    js = "'\"' || replace(replace(replace({0}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n') || '\"'"
    return f"""SELECT conv_id, sha1('[' || string_agg('{{"index": ' || idx || ', "sender": ' || {js.format("sender")} || ', "text": ' || {js.format("text")} || ', "uuid": ' || {js.format("uuid")} || '}}', ', ' ORDER BY idx) || ']') AS fingerprint FROM {source} GROUP BY conv_id"""


@query(f"WITH {_TURN} {_print('m')}")
def fingerprints(spark, sf_dir):
    return diff.fingerprints(_msgs(spark, sf_dir), "conv_id")


_CURRENT = f"WITH {_TURN}, cm AS (SELECT * REPLACE (CASE WHEN conv_id % 5 = 0 THEN text || '!' ELSE text END AS text) FROM m), fo AS ({_print('m')}), fc AS ({_print('cm')}), ob AS (SELECT 'u' || conv_id AS uuid, 'n' || conv_id AS name, fingerprint FROM fo WHERE conv_id % 11 <> 0), cu AS (SELECT conv_id, CASE WHEN conv_id % 13 = 1 THEN '' ELSE 'u' || conv_id END AS uuid, 'n' || conv_id AS name, conv_id % 17 = 2 AS is_empty, fingerprint FROM fc WHERE conv_id % 7 <> 0)"
_STATUS = "ds AS (SELECT coalesce(c.conv_id, -1) AS conv_ord, coalesce(c.uuid, o.uuid) AS uuid, coalesce(c.name, o.name) AS name, CASE WHEN c.conv_id IS NULL THEN 'deleted' WHEN c.uuid = '' THEN 'updated' WHEN c.is_empty THEN 'skipped_empty' WHEN o.uuid IS NULL THEN 'new' WHEN c.fingerprint = o.fingerprint THEN 'unchanged' ELSE 'updated' END AS status FROM cu c FULL JOIN ob o ON c.uuid = o.uuid)"


def _now_and_before(spark, sf_dir, gaps=True):
    rows = _msgs(spark, sf_dir)
    uuid = F.concat(F.lit("u"), F.col("conv_id").cast("string"))
    name, at = F.concat(F.lit("n"), F.col("conv_id").cast("string")), F.lit("2025-01-01").alias("updated_at")
    before = diff.fingerprints(rows, "conv_id").where("conv_id % 11 <> 0").select(uuid.alias("uuid"), name.alias("name"), at, "fingerprint")
    changed = rows.withColumn("text", F.when(F.col("conv_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    now = diff.fingerprints(changed, "conv_id")
    now = now.where("conv_id % 7 <> 0") if gaps else now
    now = now.select(F.col("conv_id").alias("conv_ord"), F.when(F.col("conv_id") % 13 == 1, "").otherwise(uuid).alias("uuid"), name.alias("name"), at, "fingerprint", (F.col("conv_id") % 17 == 2).alias("is_empty"))
    return now, before


@query(f"{_CURRENT}, {_STATUS} SELECT * FROM ds")
def diff_status(spark, sf_dir):
    return diff.classified(*_now_and_before(spark, sf_dir))


@query(f"{_CURRENT}, {_STATUS} SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in diff.STATUSES) + " FROM ds")
def diff_counts(spark, sf_dir):
    return diff.counts(diff.classified(*_now_and_before(spark, sf_dir)))


@query(f"{_CURRENT}, {_STATUS} SELECT uuid, name FROM ds WHERE status = 'deleted'")
def deleted_convs(spark, sf_dir):
    return diff.classified(*_now_and_before(spark, sf_dir)).where("status = 'deleted'").select("uuid", "name")


_WHOLE = _CURRENT.replace(" WHERE conv_id % 7 <> 0", "")


@query(f"{_WHOLE} SELECT uuid, name, '2025-01-01' AS updated_at, fingerprint FROM cu WHERE uuid <> '' AND NOT is_empty")
def snapshot(spark, sf_dir):
    return diff.snapshot(_now_and_before(spark, sf_dir, gaps=False)[0])


def _exported(rows: DataFrame) -> DataFrame:
    m = rows.select("conv_ord", "uuid", "name", "created_at", "updated_at", F.posexplode("chat_messages").alias("pos", "m"))
    return m.select("conv_ord", "uuid", "name", "created_at", "updated_at", F.col("pos").cast("long").alias("position"), "m.sender", "m.render_kind", "m.text", F.col("m.uuid").alias("message"), F.col("m.created_at").alias("at"))


_TRANSCRIPT = f"SELECT conv_id, turn, {_SENDER} AS sender, CASE WHEN turn % 2 = 0 THEN concat(text, chr(10), '---', chr(10), 'rest') ELSE concat(text, chr(10), '```', chr(10), '## You', chr(10), '```') END AS text FROM conversations WHERE role <> 'system'"


def transcripts(spark, sf_dir):
    """(conv_ord, file_name, value) of transcripts."""
    rows = _view(spark, sf_dir, _TRANSCRIPT)
    head = F.when(F.col("sender") == "human", F.lit("## \U0001f464 You")).otherwise(F.lit("## \U0001f916 Gemini"))
    part = F.concat(head, F.lit("\n\n"), "text", F.lit("\n\n---\n\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "")
    docs = rows.groupBy("conv_id").agg(F.concat(F.lit("# Gemini Chat Export\n\n> Exported on: 2026/5/13 15:00:00\n\n---\n\n"), body).alias("value"))
    name = F.concat(F.lit("2025-02-03_Chat_no_"), F.col("conv_id").cast("string"), F.lit(".md"))
    return docs.select(F.col("conv_id").alias("conv_ord"), name.alias("file_name"), "value")


@query(rf"""WITH t AS ({_TRANSCRIPT}), f AS (SELECT conv_id, '2025-02-03_Chat_no_' || conv_id || '.md' AS fn FROM t GROUP BY 1), b AS (SELECT t.*, sha1(fn)[1:12] AS uuid, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM t JOIN f USING (conv_id))
SELECT conv_id AS conv_ord, uuid, 'Chat no ' || conv_id AS name, '2025-02-03T00:00:00+09:00' AS created_at, '2026-05-13T15:00:00+09:00' AS updated_at, position, sender, 'text' AS render_kind, {_STRIP.format("text")} AS text, uuid || ':' || printf('%04d', position) AS message, '2025-02-03T00:00:00+09:00' AS at FROM b""")
def parse_export_md(spark, sf_dir):
    return _exported(export_md.normalized(transcripts(spark, sf_dir)))


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS position FROM conversations)
SELECT conv_id AS conv_ord, 'u' || conv_id AS uuid, 'n' || conv_id AS name, '2025-01-01' AS created_at, '' AS updated_at, position, CASE WHEN turn % 2 = 0 THEN 'human' WHEN role = 'user' THEN 'human' ELSE 'assistant' END AS sender, 'text' AS render_kind, text, CASE WHEN turn % 3 = 0 THEN 'm' || turn ELSE 'u' || conv_id || ':' || printf('%04d', position) END AS message, '2025-01-01' AS at FROM c""")
def parse_flat_json(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    nothing = F.lit(None).cast("string")
    content = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    message = F.struct(
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("m"), F.col("turn").cast("string"))).alias("uuid"),
        F.when(F.col("turn") % 2 == 0, F.lit("human")).alias("sender"),
        F.col("role").alias("raw_role"),
        (-F.col("turn")).alias("index"),
        F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(nothing).alias("text"),
        F.when(F.col("turn") % 2 == 1, content).alias("content"),
    )
    text = lambda p: F.concat(F.lit(p), F.col("conv_id").cast("string"))
    convs = rows.groupBy("conv_id").agg(F.collect_list(message).alias("chat_messages"))
    raw = F.to_json(F.struct(text("u").alias("id"), text("n").alias("name"), F.lit("2025-01-01").alias("created_at"), "chat_messages"))
    return _exported(flat_json.normalized(convs.select(F.col("conv_id").alias("conv_ord"), raw.alias("raw"))))


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations WHERE role <> 'system' OR conv_id % 2 = 0)
SELECT conv_id AS conv_ord, 'u' || conv_id AS uuid, 'n' || conv_id AS name, '2024-12-19T06:00:00+00:00' AS created_at, '' AS updated_at, position, CASE role WHEN 'user' THEN 'human' ELSE role END AS sender,
CASE WHEN role = 'system' THEN 'system_instruction' WHEN turn % 5 = 2 THEN 'image_ref' ELSE 'text' END AS render_kind, CASE WHEN role <> 'system' AND turn % 5 = 2 THEN text || chr(10) || '[image: f' || turn || ']' ELSE text END AS text, 'n' || turn AS message, '2024-12-19T06:' || printf('%02d', turn) || ':00.500000+00:00' AS at FROM c""")
def parse_tree_json(spark, sf_dir):
    rows = tree_exports(spark, sf_dir)
    return _exported(tree_json.normalized(rows.select(F.col("conv_id").alias("conv_ord"), "raw")))


def tree_exports(spark, sf_dir):
    """(conv_id, raw) of conversations as trees."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    turn = F.col("turn").cast("string")
    image = F.concat(F.lit(', {"content_type": "image_asset_pointer", "asset_pointer": "f'), turn, F.lit('"}'))
    pictured = (F.col("turn") % 5 == 2) & (F.col("role") != "system")
    node = F.concat(
        F.lit('"n'), turn, F.lit('": {"message": {"author": {"role": '), quoted(F.col("role")), F.lit('}, "create_time": '), (F.lit(1734588000.5) + F.col("turn") * 60).cast("decimal(20,1)").cast("string"),
        F.lit(', "metadata": {"is_user_system_message": '), (F.col("conv_id") % 2 == 0).cast("string"), F.lit('}, "content": {"content_type": "'), F.when(pictured, "multimodal_text").otherwise("text"),
        F.lit('", "parts": ['), quoted(F.col("text")), F.when(pictured, image).otherwise(""), F.lit(", \"\"]}}}"),
    )
    nodes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("turn")).alias("k"), node.alias("v"))), ), lambda x: x["v"]), ", ")
    convs = rows.groupBy("conv_id").agg(nodes.alias("nodes"))
    c = F.col("conv_id").cast("string")
    raw = F.concat(F.lit('{"conversation_id": "u'), c, F.lit('", "title": "n'), c, F.lit('", "create_time": 1734588000, "mapping": {"root": {"message": null}, '), "nodes", F.lit("}}"))
    return convs.select("conv_id", raw.alias("raw"))


@query("SELECT conv_id, dense_rank() OVER (ORDER BY conv_id // 10, conv_id) - 1 AS conv_ord FROM (SELECT DISTINCT conv_id FROM conversations)")
def file_order(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct()
    name = F.format_string("f%08d.json", F.floor(F.col("conv_id") / 10))
    rows = rows.withColumn("file_name", name).withColumn("file_pos", F.row_number().over(W.partitionBy("file_name").orderBy("conv_id")) - 1)
    return files.numbered(rows).select("conv_id", "conv_ord")


@query(rf"""WITH e AS ({_BLANKED}), g AS (SELECT conv_id, avg(regexp_matches(text, '^\s*$')::INT) >= 0.95 AS is_empty FROM e GROUP BY 1)
SELECT count(*) AS n_conversations, count(*) FILTER (NOT is_empty) AS n_saved, count(*) FILTER (is_empty) AS n_skipped FROM g""")
def export_counters(spark, sf_dir):
    rows = messages.empty_stats(_view(spark, sf_dir, _BLANKED), "conv_id")
    return rows.agg(F.count(F.lit(1)).alias("n_conversations"), F.count_if(~F.col("is_empty")).alias("n_saved"), F.count_if(F.col("is_empty")).alias("n_skipped"))


@query(r"WITH t AS (SELECT doc_id, text || chr(10) || chr(9) AS text FROM documents) SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS stripped, len(string_split(text, chr(10))) AS n_lines FROM t")
def python_text(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text", F.concat("text", F.lit("\n\t")))
    return rows.select("doc_id", pytext.strip("text").alias("stripped"), F.size(pytext.splitlines("text")).cast("long").alias("n_lines"))
