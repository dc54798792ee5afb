"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embeddings, infill, langid, licenses, lines, packing, sharding, simhash, substrings, suffixes, timestamps, toxicity
from .common import table


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeated_windows(table(spark, sf_dir, "documents")).drop("kept")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.drop_repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary lies on this machine and, by the same installed package, on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Bytes of a shard, as a loader reads them at a time.
SHARD_BYTES = 1 << 20


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.normalise(table(spark, sf_dir, "stamps"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    back = infill.restored(F.col("output"), F.col("form"))
    digests = {"output_sha256": F.sha2(F.col("output").cast("binary"), 256), "restored_sha256": F.sha2(back.cast("binary"), 256)}
    return made.withColumns(digests).drop("output")


QUERIES = {"op1_sharding": op1_sharding, "op2_decontamination": op2_decontamination, "op3_licenses": op3_licenses, "op4_toxicity": op4_toxicity, "op5_packing": op5_packing, "op6_suffixes": op6_suffixes, "op7_embeddings": op7_embeddings, "op8_langid": op8_langid, "op9_simhash": op9_simhash, "op10_substrings": op10_substrings, "op11_lines": op11_lines, "op12_timestamps": op12_timestamps, "op13_infill": op13_infill}
ORACLE_SQL: dict[str, str] = {
    "op1_sharding": f"""
        WITH r AS (SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT AS h, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
        s AS (SELECT d.depth, h >> (32 - d.depth) AS bits, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows FROM r, (SELECT CAST(range AS INTEGER) AS depth FROM range(0, 33)) d GROUP BY ALL),
        c AS (SELECT r.*, s.*, row_number() OVER (PARTITION BY doc_id ORDER BY s.depth) AS k FROM r JOIN s ON s.bits = r.h >> (32 - s.depth) WHERE shard_bytes <= {SHARD_BYTES} OR s.depth = 32)
        SELECT doc_id, n_bytes, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(bits), depth, '0') END AS shard, CAST(0 AS BIGINT) AS page, shard_bytes, shard_rows FROM c WHERE k = 1""",
    "op7_embeddings": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
        reach AS (SELECT vec_id AS n, vec_id AS r FROM v UNION SELECT reach.n, l.b FROM reach JOIN l ON l.a = reach.r),
        c AS (SELECT n, min(r) AS component_id FROM reach GROUP BY n),
        k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c ON c.n = v.vec_id LEFT JOIN k ON k.a = v.vec_id""",
    "op6_suffixes": r"""
        WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
        p AS (SELECT doc_id, CAST(i AS BIGINT) AS i, CASE WHEN i + 99 < n THEN md5(substr(x, 2 * i + 1, 200)) END AS k FROM h, unnest(range(0, n)) t(i)),
        f AS (SELECT doc_id, i, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM p),
        m AS (SELECT doc_id, i, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
        s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS begins FROM m),
        k AS (SELECT s.doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(substr(x, 2 * i + 1, 2), '' ORDER BY i) FILTER (NOT gone) AS kept FROM s JOIN h USING (doc_id) GROUP BY s.doc_id)
        SELECT h.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN k USING (doc_id)""",
    "op10_substrings": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, CAST(i AS BIGINT) AS i, ws[i] AS word, CASE WHEN i + 19 <= len(ws) THEN array_to_string(ws[i:i + 19], ' ') END AS k FROM w, unnest(range(1, len(ws) + 1)) t(i)),
        f AS (SELECT *, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM p),
        m AS (SELECT *, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM w LEFT JOIN m USING (doc_id) GROUP BY w.doc_id, len(ws)""",
    "op11_lines": r"""
        WITH l AS (SELECT doc_id, CAST(i AS BIGINT) AS i, ls[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) t(i)),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        g AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id""",
    "op12_timestamps": r"""
        WITH s AS (SELECT stamp_id, source, zone, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM stamps),
        t AS (SELECT *, regexp_full_match(s, '[0-9]{10}|[0-9]{13}') AS epoch, '([T ]([0-9]{2}):([0-9]{2})(:([0-9]{2}))?( ?([AP]M))?( ?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?' AS tm FROM s),
        x AS (SELECT *, CASE WHEN regexp_full_match(s, '20[0-9]{2}-[0-9]{2}-[0-9]{2}' || tm) THEN 'iso' WHEN regexp_full_match(s, '20[0-9]{6}' || tm) THEN 'packed' WHEN regexp_full_match(s, '[0-9]{2}[.][0-9]{2}[.]20[0-9]{2}' || tm) THEN 'dotted' WHEN regexp_full_match(s, '[0-9]{2} (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) 20[0-9]{2}' || tm) THEN 'named' WHEN regexp_full_match(s, '[0-9]{2}/[0-9]{2}/20[0-9]{2}' || tm) THEN 'slashed' END AS shape FROM t WHERE s IS NOT NULL AND NOT epoch),
        p AS (SELECT *, CASE shape WHEN 'iso' THEN s[1:4] WHEN 'packed' THEN s[1:4] WHEN 'named' THEN s[8:11] ELSE s[7:10] END AS y,
              CASE shape WHEN 'iso' THEN s[6:7] WHEN 'packed' THEN s[5:6] WHEN 'dotted' THEN s[4:5] WHEN 'named' THEN lpad(CAST(list_position(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'], s[4:6]) AS VARCHAR), 2, '0') ELSE s[1:2] END AS m,
              CASE shape WHEN 'iso' THEN s[9:10] WHEN 'packed' THEN s[7:8] WHEN 'slashed' THEN s[4:5] ELSE s[1:2] END AS d,
              regexp_extract(CASE shape WHEN 'packed' THEN s[9:] WHEN 'named' THEN s[12:] ELSE s[11:] END, '([T ]([0-9]{2}):([0-9]{2})(:([0-9]{2}))?( ?([AP]M))?( ?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?', ['all', 'hh', 'mm', 'ss0', 'ss', 'ap0', 'ap', 'off0', 'off']) AS g FROM x WHERE shape IS NOT NULL),
        q AS (SELECT stamp_id, source, zone, shape, try_cast(y || '-' || m || '-' || d AS DATE) AS md, CASE WHEN shape = 'slashed' THEN try_cast(y || '-' || d || '-' || m AS DATE) ELSE try_cast(y || '-' || m || '-' || d AS DATE) END AS dm, g['off'] AS off, g['all'] = '' AS bare,
              try_cast(g['hh'] AS INTEGER) AS hh, try_cast(g['mm'] AS INTEGER) AS mm, coalesce(try_cast(g['ss'] AS INTEGER), 0) AS ss, g['ap'] AS ap, try_cast(g['off'][2:3] AS INTEGER) AS oh, try_cast(right(g['off'], 2) AS INTEGER) AS om FROM p),
        v AS (SELECT *, CASE WHEN bare THEN 0 WHEN mm > 59 OR ss > 59 OR (off NOT IN ('', 'Z') AND (oh > 14 OR om > 59)) THEN NULL WHEN ap = '' AND hh <= 23 THEN hh * 3600 + mm * 60 + ss WHEN ap <> '' AND hh BETWEEN 1 AND 12 THEN (hh % 12 + CASE ap WHEN 'PM' THEN 12 ELSE 0 END) * 3600 + mm * 60 + ss END AS sec,
              CASE WHEN off = '' THEN NULL WHEN off = 'Z' THEN 0 ELSE (oh * 3600 + om * 60) * CASE off[1] WHEN '-' THEN -1 ELSE 1 END END AS o FROM q),
        ok AS (SELECT * FROM v WHERE sec IS NOT NULL AND (md IS NOT NULL OR dm IS NOT NULL) AND (o IS NOT NULL OR zone IN (SELECT name FROM pg_timezone_names()))),
        votes AS (SELECT coalesce('=' || source, '') AS src, count(*) FILTER (md IS NULL) AS dms, count(*) FILTER (dm IS NULL) AS mds FROM ok WHERE shape = 'slashed' GROUP BY ALL),
        r AS (SELECT ok.*, CASE WHEN md = dm OR md IS NULL OR dm IS NULL THEN 'plain' WHEN dms > 3 * mds OR mds > 3 * dms THEN 'votes' ELSE 'default' END AS rule, CAST(CASE WHEN md IS NULL OR (dm <> md AND dms > 3 * mds) THEN dm ELSE md END AS TIMESTAMP) + to_seconds(sec) AS wall FROM ok LEFT JOIN votes ON src = coalesce('=' || source, '')),
        near AS (SELECT *, epoch_us(wall) // 1000000 AS w, (epoch_us(wall - INTERVAL 1 DAY - (timezone(zone, timezone('UTC', wall - INTERVAL 1 DAY)) - (wall - INTERVAL 1 DAY))) // 1000000 - epoch_us(wall - INTERVAL 1 DAY) // 1000000) * -1 AS b, (epoch_us(timezone(zone, timezone('UTC', wall + INTERVAL 1 DAY))) - epoch_us(wall + INTERVAL 1 DAY)) // 1000000 AS a FROM r WHERE o IS NULL),
        walls AS (SELECT *, (epoch_us(timezone(zone, make_timestamptz((w - b) * 1000000))) // 1000000 - w = 0) AS by_b, (epoch_us(timezone(zone, make_timestamptz((w - a) * 1000000))) // 1000000 - w = 0) AS by_a FROM near),
        told AS (SELECT stamp_id, (w - CASE WHEN by_a AND NOT by_b THEN a ELSE b END) * 1000000 AS utc_us, rule, rule <> 'plain' OR (a <> b AND by_a = by_b) AS ambiguous FROM walls
            UNION ALL SELECT stamp_id, (epoch_us(wall) // 1000000 - o) * 1000000, rule, rule <> 'plain' FROM r WHERE o IS NOT NULL
            UNION ALL SELECT stamp_id, CAST(s AS BIGINT) * CASE WHEN length(s) = 10 THEN 1000000 ELSE 1000 END, 'epoch', FALSE FROM t WHERE epoch)
        SELECT stamp_id, CAST(utc_us AS BIGINT) AS utc_us, coalesce(rule, 'bad') AS rule, coalesce(ambiguous, FALSE) AS ambiguous FROM stamps LEFT JOIN told USING (stamp_id)""",
    "op13_infill": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        d AS (SELECT *, CAST(len(u) AS BIGINT) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
        f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
        c AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c""",
}
