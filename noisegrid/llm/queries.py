"""The queries of this package and, where SQL expresses them, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisegrid.llm import conversations, decontaminate, langid, lm, manifest, mixing, pii, quality, simhash, tokens, toxicity, urlfilter, warc
from noisegrid.llm._common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verify(table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {f.__name__: f for f in (op1_warc, op2_decontamination, op3_toxicity, op4_pii, op5_quality, op6_langid, op7_lm, op8_simhash, op9_mixing, op10_urls, op11_manifest, op12_conversations, op13_tokens)}

#: crc32 of a text of ASCII characters, bit by bit.
_CRC = """xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)),
    lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)))"""


def _best(*ways: str) -> str:
    """The cheapest way into a state, the ASCII-least of equally cheap ones."""
    return f"list_min([{', '.join(ways)}])"


def _way(state: str, cost: str, edit: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'e': {state}.e || '{edit}'}}"


def _stay(state: str, role: str) -> str:
    """Keep a row that has the role's initial, rerole another, or pay too much if it has to go."""
    return f"{{'c': {state}.c + CASE WHEN must THEN 1000000 ELSE {{stay}} + CASE WHEN ini = '{role}' THEN 0 ELSE 3 END END, 'e': {state}.e || CASE WHEN ini = '{role}' THEN 'K' ELSE 'R' END}}".replace("{stay}", "CASE WHEN cut THEN 3 ELSE 0 END")


ORACLES = {
    "op11_manifest": f"""
        WITH RECURSIVE d AS (
          SELECT *, CASE WHEN doc_id IS NOT NULL AND {_CRC.format(text="doc_id::VARCHAR")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS text2,
                 list_reduce(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda v: CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END), lambda a, b: a || b) AS head
          FROM documents),
        l AS (
          SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
                 sha256(head || CASE WHEN text2 IS NULL THEN '-' ELSE strlen(text2) || ':' || text2 END) AS leaf2 FROM d),
        p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM l),
        t AS (
          SELECT source, 0 AS lvl, i, n, leaf AS h FROM p
          UNION ALL
          SELECT source, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY source, lvl, i // 3, n),
        s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n, (SELECT max(lvl) FROM t AS x WHERE x.source IS NOT DISTINCT FROM t.source) AS depth FROM t WHERE n = 1),
        u AS (
          SELECT 0 AS lvl, i, n, h FROM s
          UNION ALL
          SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 3, n),
        runs AS (
          SELECT source, lvl, i // 3 AS run, list(h ORDER BY i) AS hs FROM t WHERE n > 1 GROUP BY source, lvl, i // 3
          UNION ALL
          SELECT s.source, s.depth + a.lvl, a.run, a.hs FROM s JOIN (SELECT lvl, i // 3 AS run, list(h ORDER BY i) AS hs FROM u WHERE n > 1 GROUP BY lvl, i // 3) AS a ON s.i // CAST(pow(3, a.lvl + 1) AS BIGINT) = a.run),
        f AS (
          SELECT p.doc_id, p.source, p.leaf, s.h AS subroot, s.depth, s.i AS si, 0 AS lvl, p.i, p.leaf2 AS h, '' AS proof FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source
          UNION ALL
          SELECT f.doc_id, f.source, f.leaf, f.subroot, f.depth, f.si, f.lvl + 1, CASE WHEN f.lvl + 1 = f.depth THEN f.si ELSE f.i // 3 END,
                 sha256(array_to_string(r.hs[:f.i % 3], '') || f.h || array_to_string(r.hs[f.i % 3 + 2:], '')),
                 f.proof || array_to_string(r.hs[:f.i % 3], '') || array_to_string(r.hs[f.i % 3 + 2:], '')
          FROM (SELECT * REPLACE (CASE WHEN lvl = depth THEN si ELSE i END AS i) FROM f) AS f JOIN runs AS r ON r.source IS NOT DISTINCT FROM f.source AND r.lvl = f.lvl AND r.run = f.i // 3),
        top AS (SELECT h FROM u WHERE n = 1)
        SELECT doc_id, leaf, subroot, (SELECT h FROM top) AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = (SELECT h FROM top) AS verified
        FROM f WHERE lvl = depth + (SELECT max(lvl) FROM u)""",
    "op12_conversations": f"""
        WITH RECURSIVE d AS (
          SELECT conv_id, turn, role, coalesce(text, ' ') AS text, {_CRC.format(text="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
        x AS (
          SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
                 CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
          FROM d, (VALUES (0), (1)) AS c(k) WHERE kind != 0 AND (k = 0 OR kind = 3)),
        o AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) AS i FROM x),
        g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
        r AS (SELECT *, seen = '' AS blank, seen != '' AND again AS dup, seen != '' AND NOT again AND right(seen, 1) NOT IN ('.', '!', '?') AS cut, seen = '' OR again AS must FROM g),
        v AS (
          SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'e': ''}} AS z, {{'c': 1000000, 'e': ''}} AS s, {{'c': 3, 'e': 'I'}} AS u, {{'c': 6, 'e': 'II'}} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
          UNION ALL
          SELECT conv_id, i, z, s, u3, {_best("a2", _way("u3", "3", "I"))} FROM (
            SELECT *, {_best("u2", _way("z", "3", "I"), _way("s", "3", "I"), _way("a2", "3", "I"))} AS u3 FROM (
              SELECT v.conv_id, r.i, {_way("z", "4", "D")} AS z,
                     {_best(_way("s", "4", "D"), "{'c': z.c + CASE WHEN must OR ini != 's' THEN 1000000 WHEN cut THEN 3 ELSE 0 END, 'e': z.e || 'K'}")} AS s,
                     {_best(_way("u", "4", "D"), _stay("z", "u"), _stay("s", "u"), _stay("a", "u"))} AS u2,
                     {_best(_way("a", "4", "D"), _stay("u", "a"))} AS a2
              FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i + 1))),
        e AS (SELECT conv_id, {_best("z", "a")} AS b FROM v QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
        k AS (SELECT conv_id, b.c AS cost, b.e AS audit, generate_subscripts(string_split(b.e, ''), 1) AS pos, unnest(string_split(b.e, '')) AS edit FROM e WHERE b.e != ''),
        m AS (SELECT *, count(*) FILTER (edit != 'I') OVER w AS i, count(*) FILTER (edit != 'D') OVER w AS said FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
        q AS (SELECT m.conv_id, m.pos, m.edit, m.said, r.role, r.text, max(CASE WHEN edit = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv_id) AS sys FROM m LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.i = m.i AND m.edit != 'I'),
        h AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (said - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY pos)) AS digest FROM q WHERE edit != 'D' GROUP BY conv_id),
        c AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
                 count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
        SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, e.b.c::BIGINT AS cost, e.b.e AS audit, coalesce(digest, sha256('')) AS repaired_sha256
        FROM e LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM e.conv_id""",
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
        m AS (SELECT d, min(page_id) AS first_id FROM p WHERE octet_length(b) >= 100 GROUP BY d)
        SELECT p.page_id, CAST(octet_length(p.b) AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN m.first_id IS NOT NULL AND m.first_id IS DISTINCT FROM p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN m.first_id IS DISTINCT FROM p.page_id THEN m.first_id END AS refers_to
        FROM p LEFT JOIN m ON p.d = m.d""",
    "op10_urls": """
        WITH u AS (
          SELECT page_id,
                 translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
          FROM pages),
        f AS (
          SELECT *, (host = 'example.org' OR ends_with(host, '.example.org')) AS eo,
                 (host = 'org' OR ends_with(host, '.org')) AS org, (host = 'com' OR ends_with(host, '.com')) AS com FROM u),
        r AS (
          SELECT page_id, host, path,
                 CASE WHEN eo AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                      WHEN eo AND starts_with(path, '/es/') THEN 'example.org/es/'
                      WHEN com AND starts_with(path, '/fr/') THEN 'com/fr/'
                      WHEN com AND starts_with(path, '/de/') THEN 'com/de/'
                      WHEN org AND starts_with(path, '/') THEN 'org/' END AS rule
          FROM f)
        SELECT *, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
}
