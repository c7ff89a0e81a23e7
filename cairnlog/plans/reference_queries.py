"""Every operator of the log engine as a query over the shared test tables,
with SQL that says the same in another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encoding, render, wire
from ..functions.crc32c import crc32c_column
from ..operators import kv, log, validate
from .eventlog import LOG_SQL, log as event_log, operations

SCHEMA_TAG = "cairnlog.cli.v1"
#: A number near the end of every scale: keys survive, drop and differ.
CUT_SHARE = 0.98
KEY = b"7"

_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        _found[name] = (f, None if sql is None else LOG_SQL + "\n" + sql)
        return f

    return keep


def _hex(c: str) -> Column:
    return F.hex(c)


@query("segments_list", "SELECT DISTINCT segment FROM L")
def segments_list(spark, d):
    return log.segments(event_log(spark, d))


@query("active_segment", "SELECT max(segment) AS segment FROM L")
def active_segment(spark, d):
    return log.active_segment(event_log(spark, d))


@query("next_segment", "SELECT coalesce(max(segment), 0) + 1 AS segment FROM L")
def next_segment(spark, d):
    return log.next_segment(event_log(spark, d))


@query("segment_sizes", "SELECT segment, CAST(sum(len) AS BIGINT) AS bytes, count(*) AS records FROM L GROUP BY segment")
def segment_sizes(spark, d):
    return log.segment_sizes(event_log(spark, d))


@query("scan_records", 'SELECT segment, off AS "offset", len, record_type, txid, hex(encode(key)) AS key, hex(encode(payload)) AS payload FROM L')
def scan_records(spark, d):
    e = log.in_order(event_log(spark, d))
    return e.select("segment", "offset", "len", "record_type", "txid", _hex("key").alias("key"), _hex("payload").alias("payload"))


@query("scan_cursor", "SELECT txid FROM L WHERE segment > 1 OR (segment = 1 AND off >= 500)")
def scan_cursor(spark, d):
    return log.from_cursor(event_log(spark, d), 1, 500).select("txid")


@query("scan_limit", "SELECT txid FROM (SELECT txid, segment, off FROM L ORDER BY segment, off LIMIT 25)")
def scan_limit(spark, d):
    return log.in_order(event_log(spark, d), 25).select("txid")


@query(
    "scan_json",
    f"""SELECT '{{"schema":"{SCHEMA_TAG}","kind":"record","segment":' || segment || ',"offset":' || off || ',"len":' || len
  || ',"record_type":"' || record_type || '","txid":' || txid || ',"key_base64":"' || to_base64(encode(key))
  || '","payload_base64":"' || to_base64(encode(payload)) || '"}}' AS line FROM L""",
)
def scan_json(spark, d):
    return event_log(spark, d).select(log.as_json(event_log(spark, d), SCHEMA_TAG).alias("line"))


_LITERAL = r"""CASE WHEN s = '' OR regexp_matches(s, '[ \t"\\]') THEN '"' || replace(replace(replace(s, '\', '\\'), '"', '\"'), chr(9), '\t') || '"' ELSE s END"""


def _rendered(column: str) -> str:
    body = _LITERAL.replace("s,", "left(X, 64),").replace("(s ", "(left(X, 64) ").replace("WHEN s ", "WHEN left(X, 64) ").replace("ELSE s ", "ELSE left(X, 64) ")
    return f"({body.replace('X', column)}) || CASE WHEN octet_length(encode({column})) > 64 THEN '...' ELSE '' END"


_TYPE = "CASE record_type WHEN 'Raw' THEN 'RAW' WHEN 'Put' THEN 'PUT' ELSE 'DEL' END"
_LINE = f"printf('seg=%08d off=%10d len=%8d type=%-3s txid=%10s key=', segment, off, len, {_TYPE}, CAST(txid AS VARCHAR)) || {_rendered('key')}"


@query("scan_human", f"SELECT {_LINE} || ' payload=' || {_rendered('payload')} AS line FROM L")
def scan_human(spark, d):
    return event_log(spark, d).select(render.record_line().alias("line"))


@query("dump_human", f"SELECT {_LINE} || ' key_len=' || octet_length(encode(key)) || ' payload_len=' || octet_length(encode(payload)) AS line FROM L")
def dump_human(spark, d):
    return event_log(spark, d).select(render.frame_line().alias("line"))


@query("reader_snapshot", "SELECT txid FROM L WHERE segment <= (SELECT max(segment) // 2 + 1 FROM L)")
def reader_snapshot(spark, d):
    e = event_log(spark, d)
    # The segment that was the last one at the opening is a number the reader keeps.
    last = log.active_segment(e).first()[0] // 2 + 1
    return log.snapshot(e, last).select("txid")


@query("segment_union", 'SELECT segment, off AS "offset" FROM L')
def segment_union(spark, d):
    e = event_log(spark, d)
    return log.snapshot(e, 2).unionByName(log.from_cursor(e, 3)).select("segment", "offset")


@query(
    "dump_frames",
    'SELECT segment, off AS "offset", len, record_type, txid, octet_length(encode(key)) AS key_len, octet_length(encode(payload)) AS payload_len FROM L',
)
def dump_frames(spark, d):
    e = log.headers(event_log(spark, d))
    return e.withColumns({c: F.col(c).cast("long") for c in ("key_len", "payload_len")})


@query("raw_only", "SELECT txid, hex(encode(payload)) AS payload FROM L WHERE record_type = 'Raw'")
def raw_only(spark, d):
    return log.of_type(event_log(spark, d), "Raw").select("txid", _hex("payload").alias("payload"))


@query("tombstones", "SELECT txid, hex(encode(key)) AS key FROM L WHERE record_type = 'Delete'")
def tombstones(spark, d):
    return log.of_type(event_log(spark, d), "Delete").select("txid", _hex("key").alias("key"))


@query("append_refs", 'SELECT txid, segment, off AS "offset", len FROM L')
def append_refs(spark, d):
    return log.assign_references(operations(spark, d).drop("txid")).select("txid", "segment", "offset", "len")


@query(
    "append_raw",
    """SELECT txid, CAST(coalesce(sum(28 + octet_length(encode(payload))) OVER (PARTITION BY segment ORDER BY pos
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", len
FROM (SELECT segment, pos, payload, 28 + octet_length(encode(payload)) AS len, row_number() OVER (ORDER BY pos) AS txid
      FROM L WHERE record_type = 'Raw')""",
)
def append_raw(spark, d):
    raw = operations(spark, d).where("record_type = 'Raw'").drop("txid")
    return log.assign_references(raw).select("txid", "offset", "len")


@query("rotate_transparent", 'SELECT txid, hex(encode(payload)) AS payload FROM L')
def rotate_transparent(spark, d):
    """The same records in segments of another size read the same."""
    ops = operations(spark, d).withColumn("segment", (F.floor(F.col("pos") / 333) + 1).cast("long")).drop("txid")
    return log.in_order(log.assign_references(ops)).select("txid", _hex("payload").alias("payload"))


@query("wire_size", "SELECT txid, 28 + octet_length(encode(key)) + octet_length(encode(payload)) AS size FROM L")
def wire_size(spark, d):
    return operations(spark, d).select("txid", wire.wire_size(F.col("key"), F.col("payload")).alias("size"))


def _le(value: str, size: int) -> str:
    wide = f"lpad(hex({value}), 16, '0')"
    return " || ".join(f"substr({wide}, {15 - 2 * k}, 2)" for k in range(size))


@query(
    "wire_header",
    f"""SELECT txid, '4457414C' || '0100' || CASE record_type WHEN 'Raw' THEN '00' WHEN 'Put' THEN '01' ELSE '02' END || '00'
  || {_le("txid", 8)} || {_le("octet_length(encode(key))", 4)} || {_le("octet_length(encode(payload))", 4)} AS header FROM L""",
)
def wire_header(spark, d):
    header = wire.wire_header(F.col("record_type"), F.col("txid"), F.col("key"), F.col("payload"))
    return operations(spark, d).select("txid", header.alias("header"))


@query("lww_keys", "SELECT hex(encode(key)) AS key FROM K")
def lww_keys(spark, d):
    return kv.keys(event_log(spark, d)).select(_hex("key").alias("key"))


@query("lww_items", "SELECT hex(encode(key)) AS key, hex(encode(payload)) AS value FROM K")
def lww_items(spark, d):
    return kv.items(event_log(spark, d)).select(_hex("key").alias("key"), _hex("value").alias("value"))


@query("lww_by_reference", "SELECT hex(encode(key)) AS key, hex(encode(payload)) AS value FROM K")
def lww_by_reference(spark, d):
    return kv.items_by_reference(event_log(spark, d)).select(_hex("key").alias("key"), _hex("value").alias("value"))


@query("keydir_rebuild", 'SELECT hex(encode(key)) AS key, segment, off AS "offset", len FROM K')
def keydir_rebuild(spark, d):
    return kv.keydir(event_log(spark, d)).select(_hex("key").alias("key"), "segment", "offset", "len")


@query("ref_of", """SELECT segment, off AS "offset", len FROM K WHERE key = '7'""")
def ref_of(spark, d):
    return kv.ref_of(event_log(spark, d), KEY)


@query("get_hit", "SELECT hex(encode(payload)) AS value FROM K WHERE key = (SELECT min(key) FROM K)")
def get_hit(spark, d):
    e = event_log(spark, d)
    first = kv.keys(e).agg(F.min("key")).first()[0]
    return kv.get(e, bytes(first)).select(_hex("value").alias("value"))


@query("get_miss", "SELECT hex(encode(payload)) AS value FROM K WHERE key = 'no such key'")
def get_miss(spark, d):
    return kv.get(event_log(spark, d), b"no such key").select(_hex("value").alias("value"))


@query("get_render", "SELECT left(payload, 64) AS text, CAST(NULL AS VARCHAR) AS hint FROM K")
def get_render(spark, d):
    """Printable values: the whole test table's are."""
    return kv.items(event_log(spark, d)).select(render.render_value(F.col("value")).alias("r")).select("r.text", "r.hint")


@query(
    "contains_keys",
    "SELECT hex(encode(u.key)) AS key, K.key IS NOT NULL AS live FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events) u LEFT JOIN K ON K.key = u.key",
)
def contains_keys(spark, d):
    users = spark.read.parquet(f"{d}/events.parquet").select(encoding.utf8(F.col("user_id").cast("string")).alias("key"))
    return kv.contains(event_log(spark, d), users).select(_hex("key").alias("key"), "live")


@query("live_count", "SELECT count(*) AS live_keys, count(*) = 0 AS is_empty FROM K")
def live_count(spark, d):
    return kv.count(event_log(spark, d))


@query("ref_join", "SELECT hex(encode(key)) AS key, hex(encode(payload)) AS payload FROM K")
def ref_join(spark, d):
    e = event_log(spark, d)
    return log.dereference(kv.keydir(e), e).select(_hex("key").alias("key"), _hex("payload").alias("payload"))


_REPORT = """CAST(0 AS BIGINT) AS tail_truncated, CAST(0 AS BIGINT) AS tail_bytes_discarded,
       CAST(0 AS BIGINT) AS mid_stream_errors, CAST(0 AS BIGINT) AS unsupported_versions"""


@query("recovery_report", f"SELECT count(DISTINCT segment) AS files_scanned, count(*) AS records_replayed, {_REPORT}, max(txid) AS last_txid_seen FROM L")
def recovery_report(spark, d):
    return log.recovery_report(log.with_status(event_log(spark, d)))


@query(
    "verify",
    """SELECT (SELECT count(*) FROM L) AS frames_checked, CAST(0 AS BIGINT) AS crc_failures, CAST(0 AS BIGINT) AS tail_truncated,
       CAST(0 AS BIGINT) AS tail_bytes_discarded, segment AS last_segment, off AS last_offset
FROM L ORDER BY segment DESC, off DESC LIMIT 1""",
)
def verify(spark, d):
    return log.verify(log.with_status(event_log(spark, d)))


@query("check", f"SELECT count(*) AS keys_checked, {_REPORT} FROM K")
def check(spark, d):
    e = event_log(spark, d)
    return kv.check(e, log.recovery_report(log.with_status(e)))


@query("compaction_stats", "SELECT count(*) AS live_keys, count(*) AS records_written, CAST(sum(len) AS BIGINT) AS bytes_written FROM K")
def compaction_stats(spark, d):
    return kv.compaction_stats(event_log(spark, d))


@query(
    "compact_to",
    """SELECT hex(encode(key)) AS key, hex(encode(payload)) AS payload, len, row_number() OVER (ORDER BY key) AS txid,
       CAST(coalesce(sum(len) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM K""",
)
def compact_to(spark, d):
    return kv.compact(event_log(spark, d)).select(_hex("key").alias("key"), _hex("payload").alias("payload"), "len", "txid", "offset")


_JSONL = """'{"key_b64":"' || to_base64(encode(key)) || '","value_b64":"' || to_base64(encode(payload)) || '"}'"""


@query("export_jsonl", f"SELECT {_JSONL} AS line FROM K ORDER BY key")
def export_jsonl(spark, d):
    return kv.export_lines(event_log(spark, d)).orderBy("key").select("line")


@query("export_stats", f"SELECT count(*) AS records_written, CAST(sum(octet_length(encode({_JSONL})) + 1) AS BIGINT) AS bytes_written FROM K")
def export_stats(spark, d):
    return kv.export_stats(event_log(spark, d))


@query("key_history", "SELECT txid, record_type, hex(encode(payload)) AS payload FROM L WHERE key = '7' AND record_type <> 'Raw'")
def key_history(spark, d):
    return kv.history(event_log(spark, d), KEY).select("txid", "record_type", _hex("payload").alias("payload"))


@query("contiguous_prefix", "SELECT bool_and(x = 0) AS ok, count(*) AS n FROM (SELECT txid - row_number() OVER (ORDER BY segment, off) AS x FROM L)")
def contiguous_prefix(spark, d):
    return validate.contiguous(event_log(spark, d))


def _oracle_ops(spark, d) -> DataFrame:
    """The log as oracle lines."""
    e = event_log(spark, d).where("record_type <> 'Raw'")
    value = F.when(F.col("record_type") == "Put", F.col("payload"))
    return e.select(F.col("txid").alias("seq"), F.when(F.col("record_type") == "Put", "put").otherwise("del").alias("op"), "key", value.alias("value"))


@query(
    "oracle_replay",
    """SELECT hex(encode(key)) AS key, max(txid) AS last_seq, count(*) FILTER (record_type = 'Put') AS puts,
       count(*) FILTER (record_type = 'Delete') AS dels FROM L WHERE record_type <> 'Raw' GROUP BY key""",
)
def oracle_replay(spark, d):
    return validate.replay(_oracle_ops(spark, d)).select(_hex("key").alias("key"), "last_seq", "puts", "dels")


@query("oracle_dead", "SELECT (SELECT count(DISTINCT key) FROM L WHERE record_type <> 'Raw') - (SELECT count(*) FROM K) AS dead")
def oracle_dead(spark, d):
    return validate.dead_count(_oracle_ops(spark, d))


_CUT = f"(SELECT CAST(floor(max(txid) * {CUT_SHARE}) AS BIGINT) FROM L)"
_RV = f""", R AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY txid DESC) AS nth2 FROM L WHERE record_type <> 'Raw' AND txid <= {_CUT})
  WHERE nth2 = 1 AND record_type = 'Put'
) """


def _recovered(spark, d) -> DataFrame:
    """What the log's first part gives: a store that lost its end."""
    e = event_log(spark, d)
    cut = e.agg(F.floor(F.max("txid") * CUT_SHARE)).first()[0]
    return e.where(F.col("txid") <= cut)


@query("validate_extras", _RV + "SELECT hex(encode(R.key)) AS key FROM R LEFT JOIN K ON R.key = K.key WHERE K.key IS NULL")
def validate_extras(spark, d):
    return validate.extras(kv.items(_recovered(spark, d)), kv.items(event_log(spark, d))).select(_hex("key").alias("key"))


@query(
    "validate_prefix",
    _RV + """SELECT CASE WHEN R.key IS NULL THEN 'dropped' WHEN R.payload = K.payload THEN 'survived' ELSE 'mismatch' END AS state, count(*) AS n
FROM K LEFT JOIN R ON R.key = K.key GROUP BY 1""",
)
def validate_prefix(spark, d):
    return validate.fate_counts(kv.items(_recovered(spark, d)), kv.items(event_log(spark, d)))


@query(
    "keyset_symdiff",
    _RV + """SELECT hex(encode(coalesce(R.key, K.key))) AS key, CASE WHEN R.key IS NULL THEN 'right' ELSE 'left' END AS side
FROM K FULL JOIN R ON R.key = K.key WHERE R.key IS NULL OR K.key IS NULL""",
)
def keyset_symdiff(spark, d):
    return validate.symmetric_difference(kv.items(_recovered(spark, d)), kv.items(event_log(spark, d))).select(_hex("key").alias("key"), "side")


@query("true_prefix", _RV + "SELECT 'honest' AS state, true AS ok UNION ALL SELECT 'altered', count(*) > 0 FROM L WHERE payload = 'another'")
def true_prefix(spark, d):
    """Unlike the comparison with the end state, an honest earlier state passes;
    one that holds a value that was never written does not."""
    ops, state = _oracle_ops(spark, d), kv.items(_recovered(spark, d))
    key = state.agg(F.min("key")).first()[0]
    other = F.when(F.col("key") == F.lit(key), F.lit(b"another")).otherwise(F.col("value"))
    told = [("honest", state), ("altered", state.withColumn("value", other))]
    rows = [validate.prefix_of(ops, s).select(F.lit(name).alias("state"), "ok") for name, s in told]
    return rows[0].unionByName(rows[1])


@query("render_auto", f"SELECT txid, {_rendered('payload')} AS text FROM L")
def render_auto(spark, d):
    return operations(spark, d).select("txid", render.render(F.col("payload")).alias("text"))


@query("render_hex", "SELECT txid, 'hex:' || lower(left(hex(encode(payload)), 128)) || CASE WHEN octet_length(encode(payload)) > 64 THEN '...' ELSE '' END AS text FROM L")
def render_hex(spark, d):
    return operations(spark, d).select("txid", render.render(F.col("payload"), "hex").alias("text"))


@query(
    "render_base64",
    "SELECT txid, 'b64:' || to_base64(unhex(left(hex(encode(payload)), 128))) || CASE WHEN octet_length(encode(payload)) > 64 THEN '...' ELSE '' END AS text FROM L",
)
def render_base64(spark, d):
    return operations(spark, d).select("txid", render.render(F.col("payload"), "base64").alias("text"))


@query("render_truncate", "SELECT doc_id, left(hex(encode(text)), 128) AS head FROM documents")
def render_truncate(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.hex(render.cut(encoding.utf8(F.col("text")))).alias("head"))


@query(
    "soak_streams",
    "SELECT size, count(*) AS n FROM (SELECT CASE WHEN event_id * 2654435761 % 100 < 70 THEN 'small' WHEN event_id * 2654435761 % 100 < 95 THEN 'medium' ELSE 'large' END AS size FROM events) GROUP BY size",
)
def soak_streams(spark, d):
    from ..operators.workload import stream_size

    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(stream_size(F.col("event_id")).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


@query(
    "workload_schedule",
    "SELECT event_id, CASE WHEN event_id % 23 = 22 THEN 'del' ELSE 'put' END AS op, (event_id * (1099511628211 % 4096)) & 4095 AS key_id FROM events",
)
def workload_schedule(spark, d):
    from ..operators.workload import schedule

    e = spark.read.parquet(f"{d}/events.parquet")
    return schedule(e, "event_id").select("event_id", "op", "key_id")


@query(
    "soak_counters",
    """SELECT count(*) FILTER (record_type = 'Put') AS puts, count(*) FILTER (record_type = 'Delete') AS deletes,
       count(DISTINCT segment) - 1 AS rotates, CAST(sum(len) AS BIGINT) AS bytes_written, (SELECT count(*) FROM K) AS live_keys FROM L""",
)
def soak_counters(spark, d):
    from ..operators.workload import counters

    return counters(event_log(spark, d))


@query("soak_jsonl", "SELECT to_base64(encode(CAST(user_id AS VARCHAR))) AS key, octet_length(encode(props)) AS n FROM events")
def soak_jsonl(spark, d):
    """Base64 lines, written as text and parsed again by the reader of such files."""
    from .jsonl_view import parsed

    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select(encoding.utf8(F.col("user_id").cast("string")).alias("key"), encoding.utf8(F.col("props")).alias("payload"))
    line = F.to_json(F.struct(encoding.base64_of(F.col("key")).alias("key"), encoding.base64_of(F.col("payload")).alias("payload")))
    return parsed(rows.select(line.alias("value"))).select(encoding.base64_of(F.col("key")).alias("key"), F.octet_length("payload").cast("long").alias("n"))


@query("payload_index", "SELECT event_id, event_id AS found FROM events")
def payload_index(spark, d):
    from ..operators.workload import payload_index as index

    e = spark.read.parquet(f"{d}/events.parquet")
    text = F.format_string("payload-%08d-xx", F.col("event_id"))
    return e.select("event_id", index(text).alias("found"))


@query("composite_latest", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def composite_latest(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role")
    return kv.latest_wins(c, "conv_id", "turn", ["role"])


@query("log_gaps", "SELECT segment FROM (SELECT unnest(range(2, (SELECT max(segment) FROM L))) AS segment) WHERE segment % 2 = 0")
def log_gaps(spark, d):
    """The even segments are taken away; those below the last are found missing."""
    e = event_log(spark, d)
    last = log.active_segment(e).first()[0]
    return log.gaps(e.where((F.col("segment") % 2 == 1) | (F.col("segment") == last)))


_BYTES = "list_transform(range(octet_length(encode({0}))), lambda i: CAST('0x' || substr(hex(encode({0})), CAST(2 * i + 1 AS INT), 2) AS BIGINT))"


@query(
    "crc32c_vectors",
    f""", steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END)) AS t
), b AS (SELECT txid, list_prepend(4294967295, {_BYTES.format("payload")}) AS bytes FROM ops)
SELECT txid, xor(list_reduce(bytes, lambda c, x: xor(t[CAST(xor(c, x) & 255 AS INT) + 1], c >> 8)), 4294967295) AS crc32c FROM b, steps""",
)
def crc32c_vectors(spark, d):
    return operations(spark, d).select("txid", crc32c_column("payload").alias("crc32c"))


@query(
    "fnv_fingerprint",
    f""", b AS (SELECT txid, list_prepend(14695981039346656037::UHUGEINT, list_transform({_BYTES.format("key")}, lambda x: x::UHUGEINT)) AS bytes FROM ops), h AS (
  SELECT txid, list_reduce(bytes, lambda h, x: xor(h, x) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT) AS h FROM b
) SELECT txid, format('{{:016x}}', h::UBIGINT) AS fingerprint FROM h""",
)
def fnv_fingerprint(spark, d):
    return operations(spark, d).select("txid", encoding.fnv1a64(F.col("key")).alias("fingerprint"))


from . import binary_queries  # noqa: E402, F401  registers its queries here


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}
