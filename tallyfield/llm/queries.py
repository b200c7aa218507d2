"""One query per operator, each over its whole table, and the columns its contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.chat import render_conversations
from tallyfield.llm.collocations import collocations
from tallyfield.llm.decontaminate import benchmark_spans
from tallyfield.llm.licenses import find_licenses
from tallyfield.llm.line_dedup import drop_repeated_lines
from tallyfield.llm.mixing import mix
from tallyfield.llm.ngram_join import jaccard_components
from tallyfield.llm.quality import judged
from tallyfield.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401
from tallyfield.llm.secrets import KINDS, find_secrets
from tallyfield.llm.spelling import spelling_variants
from tallyfield.llm.suffix_dedup import remove_repeats
from tallyfield.llm.token_counts import count_tokens
from tallyfield.llm.token_files import read_token_files, write_token_files
from tallyfield.llm.vocabulary import WORD_TOKENIZER


@query("op1_secret_scans")
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the fixed kinds, their digest, and all spans."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    listed = "concat_ws(',', transform({}, s -> concat_ws(':', s.kind, s.start, s.end)))"
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("bigint").alias(f"n_{k}") for k in KINDS]
    base = F.expr(listed.format("filter(spans, s -> s.kind <> 'random')"))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.expr(listed.format("spans")).alias("spans"))


@query("op2_benchmark_decontamination", """
WITH item_words AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item, array_to_string(w[k : k + 9], ' ') AS phrase, least(len(w), 10) AS n
    FROM item_words, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 9))) AS k) WHERE len(w) > 0),
words AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
places AS (
    SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS phrase
    FROM words, (SELECT DISTINCT n FROM windows), LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS k)),
hits AS (SELECT doc_id, k, p.n, item FROM places p JOIN windows USING (phrase)),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(generate_series(k, k + n - 1)) AS j FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
    sha256(coalesce(listed, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand inside a benchmark window, and the items they come from."""
    found = benchmark_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct("items"))
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


@query("op3_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted from flat token files."""
    return count_tokens(table(spark, sf_dir, "documents"))


@query("op10_license_scans")
def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of license phrases and labels of license notices in every document."""
    found = find_licenses(table(spark, sf_dir, "documents"))
    listed = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    base, own = F.expr("transform(phrases, p -> p.label)"), F.expr("transform(notices, p -> p.label)")
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("bigint").alias("n_base"),
        F.expr("array_min(transform(phrases, p -> p.word))").alias("first_word"),
        F.expr("array_max(transform(phrases, p -> p.word))").alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, own)).alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(F.expr("array_max(transform(notices, p -> p.share))"), F.lit(0.0))).alias("score"),
    )


@query("op6_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed rules' counts, the likeness score and the verdict on every document."""
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


@query("op7_line_dedup", """
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents),
keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
first AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (SELECT doc_id, k, line, coalesce(first <> doc_id, false) AS gone FROM keyed LEFT JOIN first USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many went to an earlier document, and the digest of the rest."""
    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), n_lines="n_lines", n_dropped="n_dropped")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op5_mixing_sources")
def mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document, beside its source's size and target."""
    return mix(table(spark, sf_dir, "documents"))


@query("op9_chat_formatting", """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
whole AS (
    SELECT conv_id, count(*) AS n, list(struct_pack(r := role, t := text) ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS l
    FROM turns GROUP BY conv_id),
beginnings AS (SELECT DISTINCT l[1:k] AS l FROM whole, LATERAL (SELECT unnest(generate_series(1, n - 1)) AS k)),
kept AS (SELECT l, n, min(conv_id) AS conv_id FROM whole WHERE l NOT IN (SELECT l FROM beginnings) GROUP BY l, n)
SELECT conv_id, n AS n_turns, array_to_string(list_transform(l, lambda x:
    '<|' || coalesce(x.r, 'unknown') || '|>' || chr(10) || coalesce(x.t, '') || '<|end|>' || chr(10)), '') AS text
FROM kept
""")
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal conversation as one text."""
    return render_conversations(table(spark, sf_dir, "conversations"))


@query("op8_ngram_jaccard_join", """
WITH RECURSIVE words AS (
    SELECT doc_id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), []) AS w FROM documents),
grams AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(w[k : k + 3], ' ') AS g
    FROM words, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 3))) AS k) WHERE len(w) > 0),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
    SELECT a, b FROM shared s JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * s.n >= 85 * (p.n + q.n - s.n)),
two_way AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS got FROM documents UNION SELECT r.node, t.b FROM reach r JOIN two_way t ON t.a = r.got)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT node AS doc_id, min(got) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
""")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's set of 4-word shingles, and its component of linked documents."""
    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op4_suffix_dedup", """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
windows AS (SELECT doc_id, k, md5(substr(h, 2 * k + 1, 200)) AS w FROM texts, LATERAL (SELECT unnest(range(0, n - 99)) AS k)),
firsts AS (SELECT w, min((doc_id, k)) AS first FROM windows GROUP BY w HAVING count(*) > 1),
later AS (SELECT doc_id, k FROM windows JOIN firsts USING (w) WHERE (doc_id, k) <> first),
edges AS (SELECT doc_id, k, max(k + 100) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM later),
numbered AS (SELECT doc_id, k, sum(CASE WHEN upto >= k THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM edges),
spans AS (SELECT doc_id, g, min(k) AS a, max(k) + 100 AS b FROM numbered GROUP BY 1, 2),
kept AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
    UNION ALL SELECT t.doc_id, coalesce(max(s.b), 0), t.n FROM texts t LEFT JOIN spans s USING (doc_id) GROUP BY t.doc_id, t.n),
rest AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM kept JOIN texts USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY 1)
SELECT doc_id, t.n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(s.n, 0) AS n_spans,
    sha256(unhex(rest.h)) AS kept_sha256
FROM texts t LEFT JOIN sums s USING (doc_id) JOIN rest USING (doc_id)
""")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document, how many stand in strings seen earlier, and the digest of the rest."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op11_spelling_variants", """
WITH RECURSIVE steps AS (
    SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS step FROM range(256) r(i)),
runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
counted AS (
    SELECT run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h
    FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
summed AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda k:
            16 * (instr('0123456789ABCDEF', h[2 * k + 1]) - 1) + instr('0123456789ABCDEF', h[2 * k + 2]) - 1)),
        lambda c, b: xor(c // 256, step[1 + xor(c % 256, b)])), 4294967295) AS crc
    FROM counted, steps),
words AS MATERIALIZED (
    SELECT CASE WHEN crc % 199 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, 2 + crc % length(run)) ELSE run END AS word,
        CAST(sum(n) AS BIGINT) AS n FROM summed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
gaps AS MATERIALIZED (
    SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS short, substr(word, 1, k - 1) || '_' || substr(word, k + 1) AS open
    FROM words, LATERAL (SELECT unnest(generate_series(1, length(word))) AS k)),
near AS MATERIALIZED (
    SELECT x.word, y.word AS other, y.n FROM gaps x JOIN gaps y ON x.open = y.open AND x.word <> y.word
    UNION SELECT g.word, v.word, v.n FROM gaps g JOIN words v ON g.short = v.word
    UNION SELECT v.word, g.word, g.n FROM gaps g JOIN words v ON g.short = v.word),
best AS (SELECT word, count(*) AS n_near, first(struct_pack(form := other, n := n) ORDER BY n DESC, other) AS b FROM near GROUP BY word),
linked AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 5 * w.n THEN b.form END AS form, CASE WHEN b.n >= 5 * w.n THEN b.n END AS form_n
    FROM words w LEFT JOIN best USING (word)),
chain AS (
    SELECT word, coalesce(form, word) AS at, form IS NULL AS done FROM linked
    UNION ALL SELECT c.word, coalesce(l.form, c.at), l.form IS NULL FROM chain c JOIN linked l ON l.word = c.at WHERE NOT c.done)
SELECT l.word, l.form, c.at AS root, l.n, l.n_near, l.form_n FROM linked l JOIN chain c ON c.word = l.word AND c.done
""")
def spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents, their neighbours and the form they are a variant of."""
    return spelling_variants(table(spark, sf_dir, "documents"))


@query("op12_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's token ids, read back from packed files."""
    path = write_token_files(table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    found = read_token_files(spark, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op13_collocations", """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS MATERIALIZED (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
placed AS (SELECT lang, p, unnest(w) AS w1, unnest(generate_series(1, len(w))) AS k FROM split),
ahead AS (
    SELECT lang, w1, w1 || ' ' || lead(w1, 1) OVER q AS w2, w1 || ' ' || lead(w1, 1) OVER q || ' ' || lead(w1, 2) OVER q AS w3,
        w1 || ' ' || lead(w1, 1) OVER q || ' ' || lead(w1, 2) OVER q || ' ' || lead(w1, 3) OVER q AS w4
    FROM placed WINDOW q AS (PARTITION BY p ORDER BY k)),
counts AS MATERIALIZED (
    SELECT lang, 1 AS m, w1 AS phrase, count(*) AS n FROM ahead GROUP BY ALL
    UNION ALL SELECT lang, 2, w2, count(*) FROM ahead WHERE w2 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, 3, w3, count(*) FROM ahead WHERE w3 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, 4, w4, count(*) FROM ahead WHERE w4 IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM counts WHERE m = 1 GROUP BY 1),
candidates AS MATERIALIZED (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND n >= 30),
cuts AS (
    SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 : m], ' ') AS rest
    FROM candidates, LATERAL (SELECT unnest(generate_series(1, m - 1)) AS k)),
known AS MATERIALIZED (SELECT lang || chr(9) || phrase AS key, n FROM counts WHERE n >= 30),
scored AS (
    SELECT c.lang, c.phrase, c.a, k, f.n AS l, g.n AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (f.n + g.n) AS BIGINT) AS score
    FROM cuts c JOIN known f ON f.key = c.lang || chr(9) || c.first JOIN known g ON g.key = c.lang || chr(9) || c.rest),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (
    SELECT lang, array_to_string(w[k : k + s - 1], ' ') AS phrase, max(a) AS most
    FROM candidates, LATERAL (SELECT unnest(generate_series(2, m - 1)) AS s), LATERAL (SELECT unnest(generate_series(1, m - s + 1)) AS k)
    GROUP BY 1, 2),
kept AS (SELECT w.* FROM worst w LEFT JOIN held h USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score
FROM kept JOIN totals t USING (lang) QUALIFY rank <= 2000
""")
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's phrases whose words stand together most."""
    return collocations(table(spark, sf_dir, "documents"))
