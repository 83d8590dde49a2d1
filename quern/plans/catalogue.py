"""The queries of the engine's own operators, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import limits, values
from quern.operators import documents as docs_
from quern.operators import config, edits, protocols, transcripts

from . import wires

FLAGSHIP = "doc_chunk_heading"
FIXED, RECURSIVE, PIECE, MODEL = 256, 200, 7, "m1"

# Markup backends that read and write, that lie outside, and that are known by name only.
BACKENDS = {"implemented": ("asciidoc", "latex", "markdown", "typst"), "external-candidate": ("texinfo",),
            "tracked": ("bbcode", "creole", "djot", "myst", "org", "rest", "textile", "wikitext")}


def _path() -> Column:
    return F.array_join("heading_path", " > ").alias("heading_path")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_.headed(_table(spark, sf_dir, "conversations"))


def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_.blocks(_headed(spark, sf_dir)).select("doc_id", "block_ix", "kind", "text", "start", "end", _path(), "level")


def doc_chunk_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_.chunk_heading(_headed(spark, sf_dir)).select("doc_id", "chunk_ix", "text", "start", "end", _path())


def doc_chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_.chunk_recursive(_headed(spark, sf_dir), RECURSIVE).select("doc_id", "chunk_ix", "text", "start", "end", _path())


def doc_chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_.chunk_fixed(_table(spark, sf_dir, "documents").select("doc_id", "text"), FIXED).select("doc_id", "chunk_ix", "text", "start", "end")


def doc_format_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _table(spark, sf_dir, "documents").select("doc_id", "text").union(_headed(spark, sf_dir))
    return docs_.format_of(every).groupBy("format").agg(F.count(F.lit(1)).alias("n"))


def doc_backend_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(b, status, status == "implemented") for status, names in BACKENDS.items() for b in names]
    return spark.createDataFrame(rows, "backend string, status string, works boolean").select("backend", "status", F.col("works").alias("can_read"), F.col("works").alias("can_write"))


def md_to_typst(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _headed(spark, sf_dir).withColumn("text", F.replace(F.col("text"), F.lit("the "), F.lit("the #1 *a* _b_ `c` $d @e <f> \\ ")))
    return docs_.markdown_to_typst(docs_.blocks(marked))


def json_untagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", F.explode(values.object_fields(F.col("props"))).alias("f"))
    return rows.select("event_id", "f.key", "f.domain", F.col("f.raw").alias("canonical"))


def json_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = values.tagged_map(values.object_fields(F.col("props")), lambda e: values.tagged_string(e["key"]), lambda e: values.tagged_number(e["raw"]))
    return _table(spark, sf_dir, "events").select("event_id", tagged.alias("expr"))


def json_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit('{"a":1,"'), F.when(F.col("event_id") % 3 == 0, "a").otherwise("b"), F.lit('":'), F.col("props"), F.lit("}"))
    return _table(spark, sf_dir, "events").select("event_id", values.repeated_keys(made).alias("repeated"))


def base64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text", values.canonical_base64(F.encode("text", "utf-8")).alias("b64"))
    return rows.select("doc_id", "b64", (F.decode(F.unbase64("b64"), "utf-8") == F.col("text")).alias("same"))


def limits_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", limits.string_bytes(F.col("text"), 8192).alias("error"))
    return rows.where("error is not null")


def openai_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcripts.openai_request(transcripts.conversations(_table(spark, sf_dir, "conversations")), MODEL)
    out = transcripts.decode_request(rows)
    prior = F.array_join(F.transform("prior", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return out.select("conv_id", "provider", "model", "task", prior.alias("prior"), "error")


def anthropic_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcripts.anthropic_request(transcripts.conversations(_table(spark, sf_dir, "conversations")), MODEL)
    body = lambda p: F.get_json_object("body", p)
    n = F.json_array_length(body("$.messages")).cast("long")
    return rows.select("conv_id", body("$.system").alias("system"), n.alias("n_messages"), body("$.messages[0].content").alias("first"))


def transcript_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.validate(transcripts.conversations(_table(spark, sf_dir, "conversations"))).select("conv_id", "reason")


def sse_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").where("role = 'assistant'")
    answers = turns.select((F.col("conv_id") * 100000 + F.col("turn")).alias("response_id"), "text")
    return transcripts.reassemble(transcripts.stream_frames(answers, PIECE))


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("long")
    zero = F.lit(0).cast("long")
    answer = F.col("role") == "assistant"
    turns = _table(spark, sf_dir, "conversations").select(
        "conv_id", F.when(answer, zero).otherwise(n).alias("input_tokens"), F.when(answer, n).otherwise(zero).alias("output_tokens")
    )
    return transcripts.usage_totals(turns, "conv_id")


def provider_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(transcripts.PROFILES), "provider string, request_wire string, stream_wire string")


ENVELOPES = (
    '{"jsonrpc":"2.0","id":1,"method":"tools/list"}',
    '{"jsonrpc":"2.0","method":"notify","params":{}}',
    '{"jsonrpc":"2.0","id":"x","result":{}}',
    '{"jsonrpc":"2.0","id":1,"error":{"code":1,"message":"m"}}',
    '[{"jsonrpc":"2.0","id":1,"method":"m"}]',
    '{"jsonrpc":"1.0","id":1,"method":"m"}',
    '{"jsonrpc":"2.0","id":true,"method":"m"}',
    '{"jsonrpc":"2.0","id":1,"method":"m","result":1}',
    '{"jsonrpc":"2.0","id":1,"method":"m","more":1}',
    '{"jsonrpc":"2.0","id":1,"id":2,"method":"m"}',
)


def mcp_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("event_id") % len(ENVELOPES) + 1).cast("int")
    rows = _table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*[F.lit(x) for x in ENVELOPES]), at).alias("wire"))
    return rows.select("event_id", protocols.classify_envelope(F.col("wire")).alias("kind"))


KINDS = ("Given", "Frame", "Call", "Return", "Given", "Weave", "Return", "Review", "Vote", "Patch", "Receipt")


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets made of events: three successive ones of a user are one packet's parts."""
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (F.col("event_id") % len(KINDS) + 1).cast("int"))
    rows = _table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("packet"), "event_id", kind.alias("kind"))
    rows = rows.groupBy("packet").agg(F.sort_array(F.collect_list(F.struct("event_id", "kind"))).alias("p"))
    return rows.select("packet", F.transform("p", lambda x: x["kind"]).alias("parts"))


def bridge_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = protocols.matching_profiles(F.col("parts"))
    return _packets(spark, sf_dir).select("packet", protocols.part_letters(F.col("parts")).alias("letters"), F.array_join(found, ",").alias("profiles"))


def bridge_check_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    intents = F.array(*[F.lit(x) for x in ("request", "reply", "fetch", "wave")])
    packets = _packets(spark, sf_dir).withColumn("intent", F.element_at(intents, (F.col("packet") % 4 + 1).cast("int")))
    return protocols.check_parts(packets, protocols.move_book(spark)).select("packet", "intent", "reason")


def bridge_legal_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = protocols.move_book(spark).select("intent")
    single = one.select(F.col("intent").alias("dialogue"), F.array("intent").alias("parents"))
    ended = one.select(F.concat("intent", F.lit("+receipt")).alias("dialogue"), F.array("intent", F.lit("receipt")).alias("parents"))
    opened = spark.range(1).select(F.lit("").alias("dialogue"), F.array().cast("array<string>").alias("parents"))
    return protocols.legal_replies(single.union(ended).union(opened))


def index_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: _table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation", "region", "supplier", "part")}
    return protocols.integrity(
        protocols.dangling(t["lineitem"], "l_orderkey", t["orders"], "o_orderkey", "lineitem-orders"),
        protocols.dangling(t["orders"], "o_custkey", t["customer"], "c_custkey", "orders-customer"),
        protocols.dangling(t["lineitem"], "l_partkey", t["part"].where("p_size <= 25"), "p_partkey", "lineitem-small part"),
        protocols.dangling(t["customer"], "c_nationkey", t["nation"], "n_nationkey", "customer-nation"),
        protocols.dangling(t["supplier"], "s_nationkey", t["nation"].where("n_regionkey < 3"), "n_nationkey", "supplier-nation"),
        protocols.dangling(t["nation"], "n_regionkey", t["region"].where("r_regionkey < 3"), "r_regionkey", "nation-region"),
    )


def symbol_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(r"[^ \t\n]+"), 0)
    rows = _table(spark, sf_dir, "documents").select("doc_id", values.symbol_dictionary(words).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_symbols"), F.array_join("s", " ").alias("symbols"))


def decode_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").where("role = 'assistant'")
    provider = F.element_at(F.array(*[F.lit(p) for p in transcripts.ANSWERS]), (F.col("turn") % 3 + 1).cast("int"))
    n = F.length("text")
    text = F.col("text")
    body = (
        F.when(F.col("conv_id") % 5 == 0, F.to_json(F.struct(F.struct(F.lit("busy").alias("message")).alias("error"))))
        .when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices"), F.struct(n.alias("completion_tokens")).alias("usage"))))
        .when(F.col("turn") % 3 == 1, F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"), F.lit("end_turn").alias("stop_reason"), F.struct(F.lit(3).alias("input_tokens"), n.alias("output_tokens")).alias("usage"))))
        .otherwise(F.to_json(F.struct(text.alias("response"), n.alias("eval_count"))))
    )
    rows = turns.select("conv_id", "turn", provider.alias("provider"), body.alias("body"))
    return transcripts.decode_response(rows, F.col("provider")).select("conv_id", "turn", "provider", "text", "stop_reason", "input_tokens", "output_tokens", "total_tokens", "error")


def edit_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, made = _edits(spark, sf_dir)
    once = edits.apply(found, made)
    return edits.apply(once, edits.invert(edits.applied(once, made))).select("doc_id", "block_ix", "text", "error")


def edit_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, made = _edits(spark, sf_dir)
    return edits.apply(found, made).select("doc_id", "block_ix", "text", "dirty", "error")


def _edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Blocks, and one edit of each document: its block 0, 1 or 2 is replaced or deleted, or one is inserted there; some have the wrong old text."""
    found = docs_.blocks(_headed(spark, sf_dir)).select("doc_id", "block_ix", "text")
    op = F.element_at(F.array(F.lit("replace"), F.lit("insert"), F.lit("delete")), (F.col("doc_id") % 3 + 1).cast("int"))
    made = found.where("block_ix = floor(doc_id / 3) % 3").select("doc_id", op.alias("op"), F.col("block_ix").alias("at"), F.col("text").alias("old"), F.lit("new text").alias("new"))
    old = F.when(F.col("doc_id") % 10 == 9, "another text").otherwise(F.col("old"))
    made = made.withColumns({"old": F.when(F.col("op") != "insert", old), "new": F.when(F.col("op") != "delete", F.col("new"))})
    return found, made


def config_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.encode(config.settings(_config_texts(spark, sf_dir)))


def config_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.settings(_config_texts(spark, sf_dir)).select("doc_id", "section", "key", "kind", "value", "error")


def _config_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array(
        F.concat(F.lit("[customer/"), F.col("c_custkey"), F.lit("]")),
        F.concat(F.lit('name = "'), F.col("c_name"), F.lit('"')),
        F.concat(F.lit("nation = "), F.col("c_nationkey")),
        F.lit("# a comment"),
        F.when(F.col("c_nationkey") % 5 == 0, "nation = 1.5").when(F.col("c_nationkey") % 5 == 1, "name = true").otherwise("tags = [1, true]"),
    )
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("doc_id"), F.array_join(lines, "\n").alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        doc_blocks, doc_chunk_heading, doc_chunk_recursive, doc_chunk_fixed, doc_format_counts, doc_backend_catalog, md_to_typst, json_untagged,
        json_tagged, json_repeated_keys, base64_roundtrip, limits_filter, openai_request, anthropic_request, transcript_validate,
        sse_reassemble, usage_totals, provider_profiles, mcp_classify, bridge_profile, bridge_check_parts, bridge_legal_replies,
        index_integrity, symbol_dictionary, decode_responses, edit_inverse, edit_apply, config_settings, config_encode,
    )
}
QUERIES |= wires.QUERIES

_DOCS = """docs AS (SELECT conv_id AS doc_id, '# Conversation ' || conv_id || chr(10) || chr(10) || string_agg(t, '' ORDER BY turn, t) AS text
  FROM (SELECT conv_id, turn, '## ' || coalesce(role, '') || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) AS t FROM conversations)
  GROUP BY conv_id)"""
_BLOCKS = f"""{_DOCS},
parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM docs),
raw AS (SELECT doc_id, i AS line_ix, p[i + 1] AS line, len(p) AS n FROM (SELECT doc_id, p, unnest(range(len(p))) AS i FROM parts)),
kept AS (SELECT * FROM raw WHERE line_ix < n - 1 OR line <> ''),
placed AS (SELECT doc_id, line_ix, line, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_ix
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM kept),
kinds AS (SELECT *, start + strlen(line) AS stop, length(regexp_extract(line, '^\\s*(#{{1,6}})\\s+(\\S.*)$', 1)) AS level,
  trim(regexp_extract(line, '^\\s*(#{{1,6}})\\s+(\\S.*)$', 2)) AS title FROM placed),
named AS (SELECT *, CASE WHEN level > 0 THEN 'heading' WHEN regexp_matches(line, '^\\s*$') THEN 'blank' ELSE 'paragraph' END AS kind FROM kinds),
islands AS (SELECT *, sum((kind <> 'paragraph')::INT) OVER w AS island, sum((kind = 'heading')::INT) OVER w AS section FROM named
  WINDOW w AS (PARTITION BY doc_id ORDER BY line_ix)),
found AS (SELECT doc_id, kind, min(start) AS start, max(stop) AS stop, string_agg(line, chr(10) ORDER BY line_ix) AS body, max(title) AS title,
  max(level) AS level, max(section) AS section FROM islands WHERE kind <> 'blank' GROUP BY doc_id, island, kind),
heads AS (SELECT doc_id, section, level, title FROM found WHERE kind = 'heading'),
paths AS (SELECT doc_id, section, [title] AS path FROM heads WHERE section = 1
  UNION ALL SELECT h.doc_id, h.section, list_append(list_slice(p.path, 1, h.level - 1), h.title) FROM paths p JOIN heads h
  ON h.doc_id = p.doc_id AND h.section = p.section + 1),
blocks AS (SELECT f.doc_id, (row_number() OVER (PARTITION BY f.doc_id ORDER BY f.start) - 1)::INT AS block_ix, kind,
  CASE WHEN kind = 'heading' THEN title ELSE body END AS text, start, stop, coalesce(array_to_string(path, ' > '), '') AS heading_path,
  CASE WHEN kind = 'heading' THEN level::INT END AS level FROM found f LEFT JOIN paths p ON p.doc_id = f.doc_id AND p.section = f.section)"""


_MARKED = _BLOCKS.replace("docs AS (SELECT conv_id AS doc_id, '# Conversation", "docs AS (SELECT doc_id, replace(text, 'the ', 'the #1 *a* _b_ `c` $d @e <f> \\ ') AS text FROM (SELECT conv_id AS doc_id, '# Conversation").replace(
    "  GROUP BY conv_id)", "  GROUP BY conv_id))"
)


def _windows(most: int, rows: str) -> str:
    """CTEs that cut ``rows`` (id, base, path, text) into byte windows: cut (id, base, path, text, a, b)."""
    return f"""chars AS (SELECT id, base, path, text, regexp_extract_all(text, '(?s).') AS cs FROM {rows}),
sizes AS (SELECT id, base, unnest(range(len(cs))) AS i, unnest(list_transform(cs, lambda c: strlen(c))) AS n FROM chars),
ends AS (SELECT id, base, list(e ORDER BY i) AS es FROM (SELECT id, base, i, (sum(n) OVER (PARTITION BY id, base ORDER BY i))::BIGINT AS e FROM sizes) GROUP BY id, base),
both_ AS (SELECT c.id, c.base, c.path, c.text, e.es FROM chars c JOIN ends e ON e.id = c.id AND e.base = c.base),
cut AS (SELECT id, base, path, text, es, 0::BIGINT AS a, list_max(list_filter(es, lambda e: e <= {most})) AS b FROM both_
  UNION ALL SELECT id, base, path, text, es, b, list_max(list_filter(es, lambda e: e <= b + {most})) FROM cut WHERE b < es[len(es)]),
texts AS (SELECT id, base, path, base + a AS start, base + b AS stop,
  substring(text, len(list_filter(es, lambda e: e <= a)) + 1, len(list_filter(es, lambda e: e > a AND e <= b))) AS text FROM cut)"""


_SORTED = """sorted_ AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
  count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"""


def _cases(column: str, items: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = {i} THEN '{x}'" for i, x in enumerate(items)) + " END"


def _dangling(t: str, key: str, target: str, to: str, label: str) -> str:
    return f"""SELECT '{label}' AS relation, {key}::VARCHAR AS ref, count(*) AS n FROM {t} WHERE {key} IS NOT NULL
  AND {key} NOT IN (SELECT {to} FROM {target}) GROUP BY {key}"""


_PACKETS = f"""packets AS (SELECT event_id // 3 AS packet, list({_cases("event_id % 11", KINDS)} ORDER BY event_id) AS parts FROM events GROUP BY event_id // 3),
lettered AS (SELECT packet, parts, array_to_string(list_transform(parts, lambda k: CASE k WHEN 'Review' THEN 'V' WHEN 'Vote' THEN 'O' WHEN 'Receipt' THEN 'T' ELSE left(k, 1) END), '') AS letters FROM packets)"""
_HAS = "list_contains(ks, '{}')".format

ORACLES = {
    "doc_blocks": f'WITH RECURSIVE {_BLOCKS} SELECT doc_id, block_ix, kind, text, start, stop AS "end", heading_path, level FROM blocks',
    "doc_chunk_heading": f"""WITH RECURSIVE {_BLOCKS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS chunk_ix,
  text, start, stop AS "end", heading_path FROM blocks WHERE kind = 'paragraph'
  UNION ALL SELECT doc_id, 0, text, 0, strlen(text), '' FROM docs WHERE text <> '' AND doc_id NOT IN (SELECT doc_id FROM blocks WHERE kind = 'paragraph')""",
    "doc_chunk_recursive": f"""WITH RECURSIVE {_BLOCKS},
src AS (SELECT doc_id AS id, start AS base, heading_path AS path, text FROM blocks WHERE kind = 'paragraph'
  UNION ALL SELECT doc_id, 0, '', text FROM docs WHERE text <> '' AND doc_id NOT IN (SELECT doc_id FROM blocks WHERE kind = 'paragraph')),
{_windows(RECURSIVE, "src")} SELECT id AS doc_id, (row_number() OVER (PARTITION BY id ORDER BY start) - 1)::INT AS chunk_ix, text, start, stop AS "end",
  path AS heading_path FROM texts""",
    "doc_chunk_fixed": f"""WITH RECURSIVE src AS (SELECT doc_id AS id, 0::BIGINT AS base, '' AS path, text FROM documents WHERE text <> ''),
{_windows(FIXED, "src")} SELECT id AS doc_id, (row_number() OVER (PARTITION BY id ORDER BY start) - 1)::INT AS chunk_ix, text, start, stop AS "end" FROM texts""",
    "doc_format_counts": f"""WITH {_DOCS}, every_ AS (SELECT text FROM documents UNION ALL SELECT text FROM docs)
SELECT CASE WHEN regexp_matches(coalesce(text, ''), '(?m)^[ \\t]*#{{1,6}}[ \\t]+\\S') THEN 'markdown' ELSE 'text' END AS format, count(*) AS n FROM every_ GROUP BY 1""",
    "doc_backend_catalog": """SELECT b AS backend, CASE WHEN b IN ('asciidoc', 'latex', 'markdown', 'typst') THEN 'implemented' WHEN b = 'texinfo' THEN 'external-candidate' ELSE 'tracked' END AS status,
  b IN ('asciidoc', 'latex', 'markdown', 'typst') AS can_read, b IN ('asciidoc', 'latex', 'markdown', 'typst') AS can_write
  FROM (SELECT unnest(['asciidoc', 'bbcode', 'creole', 'djot', 'latex', 'markdown', 'myst', 'org', 'rest', 'texinfo', 'textile', 'typst', 'wikitext']) AS b)""",
    "md_to_typst": f"""WITH RECURSIVE {_MARKED}, escaped AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '#', '\\#'), '*', '\\*'), '_', '\\_'),
  '`', '\\`'), '$', '\\$'), '@', '\\@'), '<', '\\<'), '>', '\\>') AS safe FROM blocks)
  SELECT doc_id, string_agg(CASE WHEN kind = 'heading' THEN repeat('=', level) || ' ' || safe ELSE safe END, chr(10) || chr(10) ORDER BY block_ix) || chr(10) AS typst,
  count(*) AS n_blocks FROM escaped GROUP BY doc_id""",
    "json_untagged": """SELECT event_id, key, 'number' AS domain, json_extract_string(props, '$.' || key) AS canonical
FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""",
    "json_tagged": """SELECT event_id, '{"$expr":"map","entries":[{"key":"k","value":{"$expr":"number","domain":"numbers/f64","value":"'
  || json_extract_string(props, '$.k') || '"}}]}' AS expr FROM events""",
    "json_repeated_keys": "SELECT event_id, event_id % 3 = 0 AS repeated FROM events",
    "base64_roundtrip": "SELECT doc_id, base64(encode(text)) AS b64, decode(from_base64(base64(encode(text)))) = text AS same FROM documents",
    "limits_filter": """SELECT doc_id, 'decode string bytes limit exceeded: ' || strlen(text) || ' > 8192' AS error FROM documents WHERE strlen(text) > 8192""",
    "openai_request": f"""WITH {_SORTED}, g AS (SELECT conv_id, max(CASE WHEN i = n THEN role END) AS last_role, max(CASE WHEN i = n THEN text END) AS task,
  string_agg(CASE WHEN i < n THEN role || ': ' || text END, chr(10) ORDER BY i) AS prior FROM sorted_ GROUP BY conv_id)
SELECT conv_id, 'openai' AS provider, CASE WHEN last_role = 'user' THEN '{MODEL}' END AS model, CASE WHEN last_role = 'user' THEN task END AS task,
  CASE WHEN last_role = 'user' THEN coalesce(prior, '') END AS prior, CASE WHEN last_role <> 'user' THEN 'the last message must be the user''s' END AS error FROM g""",
    "anthropic_request": f"""WITH {_SORTED} SELECT conv_id, string_agg(CASE WHEN role = 'system' THEN text END, chr(10) || chr(10) ORDER BY i) AS system,
  count(*) FILTER (role <> 'system') AS n_messages, min_by(text, i) FILTER (role <> 'system') AS first FROM sorted_ GROUP BY conv_id""",
    "transcript_validate": f"""WITH {_SORTED} SELECT conv_id, CASE WHEN bool_or(role NOT IN ('system', 'user', 'assistant', 'tool')) THEN 'unknown role'
  WHEN bool_or(text IS NULL OR text = '') THEN 'empty content' WHEN bool_or(role = 'system' AND i > 1) THEN 'system message after the first'
  WHEN bool_or(i = n AND role <> 'user') THEN 'no task' END AS reason FROM sorted_ GROUP BY conv_id""",
    "sse_reassemble": f"""SELECT conv_id * 100000 + turn AS response_id, text, length(text) AS output_tokens, true AS ended,
  ((length(text) + {PIECE - 1}) // {PIECE} + 2) AS n_frames FROM conversations WHERE role = 'assistant'""",
    "usage_totals": """SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN 0 ELSE length(text) END)::BIGINT AS input_tokens,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS output_tokens, sum(length(text))::BIGINT AS total_tokens FROM conversations GROUP BY conv_id""",
    "provider_profiles": """SELECT * FROM (VALUES ('openai', 'chat-completions', 'sse'), ('anthropic', 'messages', 'sse'), ('ollama', 'chat', 'ndjson'),
  ('lm-studio', 'chat-completions', 'sse'), ('lemonade', 'chat-completions', 'sse')) AS t(provider, request_wire, stream_wire)""",
    "mcp_classify": f"""WITH w AS (SELECT event_id, {_cases(f"event_id % {len(ENVELOPES)}", ENVELOPES)} AS wire FROM events),
k AS (SELECT event_id, wire, CASE WHEN wire LIKE '[%' THEN NULL ELSE json_keys(wire) END AS ks FROM w)
SELECT event_id, CASE WHEN ks IS NULL THEN 'invalid: batch' WHEN len(ks) <> len(list_distinct(ks)) THEN 'invalid: a field is named twice'
  WHEN json_extract_string(wire, '$.jsonrpc') <> '2.0' THEN 'invalid: version' WHEN json_type(wire, '$.id') IN ('BOOLEAN', 'ARRAY', 'OBJECT') THEN 'invalid: id'
  WHEN {_HAS("method")} AND {_HAS("id")} AND NOT {_HAS("result")} AND NOT {_HAS("error")}
    THEN CASE WHEN len(list_filter(ks, lambda x: x NOT IN ('jsonrpc', 'id', 'method', 'params'))) > 0 THEN 'invalid: request has an unknown field' ELSE 'request' END
  WHEN {_HAS("method")} AND NOT {_HAS("id")} AND NOT {_HAS("result")} AND NOT {_HAS("error")} THEN 'notification'
  WHEN {_HAS("id")} AND {_HAS("result")} AND NOT {_HAS("method")} AND NOT {_HAS("error")} THEN 'response'
  WHEN {_HAS("id")} AND {_HAS("error")} AND NOT {_HAS("method")} AND NOT {_HAS("result")} THEN 'error' ELSE 'invalid: field combination' END AS kind FROM k""",
    "bridge_profile": f"""WITH {_PACKETS} SELECT packet, letters, array_to_string(list_filter([
  CASE WHEN regexp_matches(letters, '^G*F*C+R$') THEN 'ask' END, CASE WHEN regexp_matches(letters, '^G*F+R?$') THEN 'brief' END,
  CASE WHEN parts[1] IN ('Review', 'Vote', 'Patch', 'Receipt') AND parts[len(parts)] IN ('Review', 'Vote', 'Patch', 'Receipt') AND (len(parts) < 3 OR parts[2] IN ('Review', 'Vote', 'Patch', 'Receipt')) THEN 'collab' END,
  CASE WHEN regexp_matches(letters, '^G*F*W+R$') THEN 'loom' END], lambda x: x IS NOT NULL), ',') AS profiles FROM lettered""",
    "bridge_check_parts": f"""WITH {_PACKETS}, i AS (SELECT packet, parts, {_cases("packet % 4", ("request", "reply", "fetch", "wave"))} AS intent FROM packets)
SELECT packet, intent, CASE WHEN intent = 'wave' THEN 'unknown move wave' WHEN intent IN ('request', 'reply') AND NOT list_contains(parts, 'Return')
  THEN intent || ' requires a Return part' WHEN intent = 'fetch' AND NOT list_contains(parts, 'Fetch') THEN 'fetch requires a Fetch part'
  WHEN intent = 'request' AND NOT list_has_any(parts, ['Frame', 'Call', 'Weave']) THEN 'request requires Frame or Call or Weave' END AS reason FROM i""",
    "bridge_legal_replies": """WITH m(intent, rule, answers) AS (VALUES ('request', 'opens', []::VARCHAR[]), ('offer', 'only', ['request']), ('reply', 'only', ['request']),
  ('review', 'only', ['offer', 'reply', 'patch']), ('vote', 'only', ['offer', 'reply']), ('patch', 'only', ['receipt', 'review', 'reply']),
  ('fetch', 'nr', []::VARCHAR[]), ('receipt', 'nr', []::VARCHAR[]), ('attest', 'only', ['reply', 'receipt']), ('error', 'any', []::VARCHAR[])),
d AS (SELECT intent AS dialogue, [intent] AS parents FROM m UNION ALL SELECT intent || '+receipt', [intent, 'receipt'] FROM m UNION ALL SELECT '', []::VARCHAR[])
SELECT dialogue, intent FROM d, m WHERE CASE rule WHEN 'opens' THEN len(parents) = 0 WHEN 'only' THEN len(parents) > 0 AND list_has_all(answers, parents)
  WHEN 'nr' THEN len(parents) > 0 AND NOT list_contains(parents, 'receipt') ELSE len(parents) > 0 END""",
    "index_integrity": " UNION ALL ".join(
        (
            _dangling("lineitem", "l_orderkey", "orders", "o_orderkey", "lineitem-orders"),
            _dangling("orders", "o_custkey", "customer", "c_custkey", "orders-customer"),
            _dangling("lineitem", "l_partkey", "(SELECT * FROM part WHERE p_size <= 25)", "p_partkey", "lineitem-small part"),
            _dangling("customer", "c_nationkey", "nation", "n_nationkey", "customer-nation"),
            _dangling("supplier", "s_nationkey", "(SELECT * FROM nation WHERE n_regionkey < 3)", "n_nationkey", "supplier-nation"),
            _dangling("nation", "n_regionkey", "(SELECT * FROM region WHERE r_regionkey < 3)", "r_regionkey", "nation-region"),
        )
    ),
    "symbol_dictionary": """SELECT doc_id, len(s) AS n_symbols, array_to_string(s, ' ') AS symbols FROM (SELECT doc_id,
  list_sort(list_distinct(regexp_extract_all(text, '[^ \\t\\n]+'))) AS s FROM documents)""",
    "decode_responses": """WITH a AS (SELECT conv_id, turn, text, conv_id % 5 = 0 AS bad, turn % 3 AS k FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CASE k WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'ollama' END AS provider, CASE WHEN NOT bad THEN text END AS text,
  CASE WHEN bad THEN 'error' WHEN k = 1 THEN 'end_turn' ELSE 'stop' END AS stop_reason, CASE WHEN NOT bad AND k = 1 THEN 3::BIGINT END AS input_tokens,
  CASE WHEN NOT bad THEN length(text) END AS output_tokens, CASE WHEN NOT bad THEN length(text) + CASE WHEN k = 1 THEN 3 ELSE 0 END END AS total_tokens,
  CASE WHEN bad THEN 'busy' END AS error FROM a""",
    "edit_inverse": f"WITH RECURSIVE {_BLOCKS} SELECT doc_id, block_ix, text, NULL::VARCHAR AS error FROM blocks",
    "edit_apply": f"""WITH RECURSIVE {_BLOCKS}, e AS (SELECT doc_id, block_ix, text, doc_id % 3 AS op, (doc_id // 3) % 3 AS pos, doc_id % 10 = 9 AND doc_id % 3 <> 1 AS bad FROM blocks),
r AS (SELECT doc_id, block_ix + CASE WHEN NOT bad AND op = 1 AND block_ix >= pos THEN 1 WHEN NOT bad AND op = 2 AND block_ix > pos THEN -1 ELSE 0 END AS block_ix,
  CASE WHEN NOT bad AND op = 0 AND block_ix = pos THEN 'new text' ELSE text END AS text, NOT bad AND op = 0 AND block_ix = pos AS dirty, bad FROM e WHERE bad OR op <> 2 OR block_ix <> pos
  UNION ALL SELECT doc_id, pos, 'new text', true, bad FROM e WHERE op = 1 AND block_ix = pos)
SELECT doc_id, block_ix::INT AS block_ix, text, dirty, CASE WHEN bad THEN 'the old text differs' END AS error FROM r""",
    "config_encode": """SELECT c_custkey::BIGINT AS doc_id, '[customer/' || c_custkey || ']' || chr(10) || 'name = "' || c_name || '"' || chr(10) || 'nation = ' || c_nationkey || chr(10)
  || CASE WHEN c_nationkey % 5 > 1 THEN 'tags = [1, true]' || chr(10) ELSE '' END AS text FROM customer""",
    "config_settings": """WITH n AS (SELECT c_custkey::BIGINT AS doc_id, 'customer/' || c_custkey AS section, c_name, c_nationkey, c_nationkey % 5 AS r FROM customer)
SELECT doc_id, section, 'name' AS key, 'string' AS kind, '"' || c_name || '"' AS value, NULL::VARCHAR AS error FROM n
UNION ALL SELECT doc_id, section, 'nation', 'int', c_nationkey::VARCHAR, NULL FROM n
UNION ALL SELECT doc_id, section, CASE r WHEN 0 THEN 'nation' WHEN 1 THEN 'name' ELSE 'tags' END, CASE r WHEN 0 THEN NULL WHEN 1 THEN 'bool' ELSE 'array' END,
  CASE r WHEN 0 THEN '1.5' WHEN 1 THEN 'true' ELSE '[1, true]' END, CASE r WHEN 0 THEN 'no value of a known kind' WHEN 1 THEN 'key given twice' END FROM n""",
}
ORACLES |= wires.ORACLES
