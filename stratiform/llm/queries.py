"""The dealt operators over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.llm import (
    chat, decontam, langid, linerules, maxscore, mixing, neardup, ngram_lm, ptolemy, quality, repair, toxicity, wavelet,
)
from stratiform.llm.sampling import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labels(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").select("doc_id", F.col(column).alias("label"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _labels(spark, sf_dir, "quality"), ~held_out("doc_id", 5, 0))
    return quality.score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out("doc_id", 4, 2))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _labels(spark, sf_dir, "toxic"), ~held_out("doc_id", 4, 2))
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ngram_lm.fit(docs.where(~held_out("doc_id", 7, 2)))
    return ngram_lm.score(docs, model).select(
        "doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read(wavelet.write(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op9_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return repair.with_all(rows, repair.digests(repair.edited(repair.damaged(rows))))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, clusters = ptolemy.cluster(_table(spark, sf_dir, "embeddings"))
    listed = F.concat_ws(",", F.transform("centroid", lambda x: x.cast("string")))
    summary = clusters.select("cluster", "cluster_inertia", "inertia", F.sha2(listed, 256).alias("centroid_sha256"))
    # A row per cluster.
    return assigned.join(F.broadcast(summary), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op13_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.clean(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file; it is the same on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {
    run.__name__: run
    for run in (
        op1_quality_classifier, op2_language_id, op3_toxicity, op4_minhash_near_dedup, op5_source_mixing,
        op6_ngram_lm, op7_wavelet_tokens, op8_chat_format, op9_maxscore_topk, op10_decontamination,
        op11_conversation_repair, op12_centroid_clustering, op13_line_rules,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

# Conversation repair. A state holds the least (cost, audit) and the repaired text that goes with it.
_STATE = "[{{'c': {0}, 't': {1}, 'o': {2}}}]"


def _best(*ways: str) -> str:
    return f"list_sort(list_concat({', '.join(f'({w})' for w in ways)}))[1:1]"


def _then(state: str, cost: str, letter: str, said: str) -> str:
    """Every way to a state, with one edit more."""
    return f"list_transform({state}, lambda w: {{'c': w.c + {cost}, 't': w.t || '{letter}', 'o': w.o || {said}}})"


def _repair_sql() -> str:
    user, assistant = "'user:' || chr(10)", "'assistant:' || chr(10)"
    own, given = "x.role || ':' || x.text || chr(10)", "'{}:' || x.text || chr(10)"
    extra = "CASE WHEN x.fault = 'truncated' THEN 5 ELSE 0 END"
    none = "CAST([] AS STRUCT(c BIGINT, t VARCHAR, o VARCHAR)[])"
    # Insertions before the edit of a row itself: to user from nothing, system or assistant, then to assistant.
    to_user = _best("a.s2", *(_then(f"a.s{k}", "5", "I", user) for k in (0, 1, 3)))
    to_assistant = _best("b.s3", _then("b.s2", "5", "I", assistant))
    gone = [_then(f"b.s{k}", "2", "D", "''") for k in range(4)]
    before_user = _best("b.s0", "b.s1", "b.s3")
    kept = {k: f"CASE WHEN x.initial = '{i}' THEN {_then(f, extra, 'K', own)} ELSE {none} END"
            for k, i, f in ((1, "s", "b.s0"), (2, "u", before_user), (3, "a", "b.s2"))}
    given_user = _then(before_user, f"1 + {extra}", "R", given.format("user"))
    given_assistant = _then("b.s2", f"1 + {extra}", "R", given.format("assistant"))
    free = [gone[0], _best(gone[1], kept[1]), _best(gone[2], kept[2], given_user), _best(gone[3], kept[3], given_assistant)]
    forced = "x.fault IN ('blank', 'duplicate')"
    after = ", ".join(f"CASE WHEN {forced} THEN {gone[k]} ELSE {free[k]} END AS s{k}" for k in range(4))
    end = _best("s0", "s3", _then("s2", "5", "I", assistant), _then(_then("s1", "5", "I", user), "5", "I", assistant))
    bits = "flatten(list_transform(string_split(k, ''), lambda c: list_concat([ord(c)], list_transform(range(8), lambda z: -1))))"
    crc = f"""xor(list_reduce({bits}, lambda h, z: CASE WHEN z >= 0 THEN xor(h, z)
        ELSE xor(h >> 1, CASE WHEN h & 1 = 1 THEN 3988292384 ELSE 0 END) END, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"""
    return f"""
        WITH RECURSIVE keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
            FROM conversations
        ),
        drawn AS (SELECT *, {crc} % 20 AS f FROM keyed),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM drawn WHERE f <> 0
        ),
        ordered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen
            FROM damaged
        ),
        rows AS (
            SELECT *, left(role, 1) AS initial,
                   left(lag(role) OVER (PARTITION BY conv_id ORDER BY n), 1) || left(role, 1) AS pair,
                   CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
            FROM ordered
        ),
        ids AS (SELECT conv_id, row_number() OVER () AS id FROM (SELECT DISTINCT conv_id FROM conversations)),
        numbered AS (SELECT i.id, r.* FROM rows r JOIN ids i ON r.conv_id IS NOT DISTINCT FROM i.conv_id),
        walk AS (
            SELECT id, CAST(0 AS BIGINT) AS n, {_STATE.format("CAST(0 AS BIGINT)", "''", "''")} AS s0, {none} AS s1, {none} AS s2, {none} AS s3
            FROM ids
            UNION ALL
            SELECT b.id, b.n + 1, {after}
            FROM (
                SELECT id, n, s0, s1, s2, {to_assistant} AS s3
                FROM (SELECT id, n, s0, s1, {to_user} AS s2, s3 FROM walk a) b
            ) b JOIN numbered x ON x.id = b.id AND x.n = b.n + 1
        ),
        ends AS (SELECT id, {end} AS best FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1)),
        counts AS (
            SELECT id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM numbered GROUP BY id
        )
        SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
               coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               best[1].c AS cost, best[1].t AS audit, sha256(left(best[1].o, greatest(length(best[1].o) - 1, 0))) AS repaired_sha256
        FROM ids i JOIN ends USING (id) LEFT JOIN counts USING (id)
    """


def _cluster_sql() -> str:
    def assign(k: int) -> str:
        return f"""
        measured{k} AS (
            SELECT r.row, c.cluster, CAST(sum((r.v - c.v) * (r.v - c.v)) AS BIGINT) AS distance
            FROM parts r JOIN centroids{k} c USING (dim) GROUP BY ALL
        ),
        assigned{k} AS (SELECT * FROM measured{k} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)"""

    def update(k: int) -> str:
        return f"""
        sums{k} AS (
            SELECT cluster, dim, CAST(sum(v) AS BIGINT) AS s, count(*) AS n
            FROM parts JOIN assigned{k} USING (row) GROUP BY ALL
        ),
        centroids{k + 1} AS (
            SELECT cluster, dim, coalesce(CAST((s - ((s % n) + n) % n) / n AS BIGINT), v) AS v
            FROM centroids{k} LEFT JOIN sums{k} USING (cluster, dim)
        )"""

    steps = ",".join(f"{assign(k)},{update(k)}" for k in range(3))
    return f"""
        WITH whole AS (
            SELECT vec_id, row_number() OVER () AS row,
                   list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS p
            FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        parts AS (SELECT row, unnest(p) AS v, unnest(range(64)) AS dim FROM whole),
        seeds AS (
            SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, p) - 1 AS INTEGER) AS cluster, row
            FROM whole QUALIFY cluster < 16
        ),
        centroids0 AS (SELECT cluster, dim, v FROM seeds JOIN parts USING (row)),{steps},{assign(3)},
        hashes AS (
            SELECT cluster, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM centroids3 GROUP BY cluster
        )
        SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM assigned3 JOIN whole USING (row) JOIN hashes USING (cluster)
    """


def _line_rules_sql() -> str:
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def count(text: str, characters: str) -> str:
        return f"(length({text}) - length(translate({text}, {quoted(characters)}, '')))"

    plain = f"translate(t, '{linerules.UPPER}', '{linerules.LOWER}')"
    phrases = " OR ".join(f"contains({plain}, {quoted(p)})" for p in linerules.PHRASES)
    signs = count("t", linerules.LINK_SIGNS)
    return rf"""
        WITH docs AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
        listed AS (
            SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS w,
                   translate(text, {space}, '') AS packed, string_split(text, chr(10)) AS lines
            FROM docs
        ),
        starts AS (
            SELECT row, unnest(range(1, len(w) - 6)) AS i, w FROM listed WHERE len(w) >= 8
        ),
        runs AS (SELECT row, i, array_to_string(w[i:i + 7], ' ') AS run FROM starts),
        again AS (SELECT row, i FROM runs QUALIFY count(*) OVER (PARTITION BY row, run) > 1),
        repeated AS (SELECT row, count(DISTINCT place) AS n FROM (SELECT row, unnest(range(i, i + 8)) AS place FROM again) GROUP BY row),
        split AS (SELECT row, unnest(lines) AS line FROM listed),
        judged AS (
            SELECT row, line, translate(line, {space}, '') AS packed, t,
                   t <> '' AND (NOT contains({quoted(linerules.ENDS)}, right(t, 1))
                   OR ({count("t", linerules.MARKS)} > 2 AND 100 * {count("t", linerules.MARKS)} > 10 * length(t))
                   OR ({signs} >= 2 AND length(t) <= 30 * ({signs} + 1))
                   OR (length(t) <= 200 AND regexp_matches({plain}, {quoted(linerules.LINK_WORDS)}))
                   OR {phrases}) AS fails
            FROM (SELECT row, line, trim(line, {space}) AS t FROM split)
        ),
        of_lines AS (
            SELECT row, count(*) FILTER (packed <> '') - count(DISTINCT line) FILTER (packed <> '') AS n_dup_lines,
                   coalesce(sum(length(packed)) FILTER (NOT fails), 0) AS kept_chars
            FROM judged GROUP BY row
        ),
        counted AS (
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(packed) AS word_chars, {count("text", linerules.SYMBOLS)} AS n_symbols,
                   coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(kept_chars, 0) AS kept_chars
            FROM listed LEFT JOIN repeated USING (row) LEFT JOIN of_lines USING (row)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
               NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * kept_chars >= 50 * word_chars AS kept
        FROM counted
    """


ORACLE: dict[str, str] = {
    "op11_conversation_repair": _repair_sql(),
    "op12_centroid_clustering": _cluster_sql(),
    "op13_line_rules": _line_rules_sql(),
    "op4_minhash_near_dedup": f"""
        WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
            FROM words
        ),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        pairs AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
            FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL
        ),
        links AS (
            SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
            WHERE 100 * common >= 75 * (p.n + q.n - common)
        ),
        reach AS (
            SELECT doc_id AS x, doc_id AS y FROM documents
            UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
        ),
        least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM documents JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
    """,
    "op8_chat_format": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        ),
        escaped AS (
            SELECT *, regexp_replace(regexp_replace(text, '\\', '\\\\', 'g'),
                '(<)(\|im_start\|>|\|im_end\|>|s>|/s>|<SYS>>|</SYS>>|\|endoftext\|>)|(\[)(INST\]|/INST\])',
                '\1\3\\\2\4', 'g') AS written
            FROM rows
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), ''))
                   AS loss_sha256,
               CAST(sum(length(role) + length(written) + 24) AS BIGINT) AS formatted_chars
        FROM escaped GROUP BY conv_id
    """,
    "op9_maxscore_topk": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS parts
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.parts, c.parts), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM scored QUALIFY rank <= 10
    """,
}
