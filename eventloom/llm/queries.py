"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, embed_dedup, hard_negatives, html_text, line_dedup, packing, pii, secrets, simhash, token_counts, topk, toxicity


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.judged(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.with_suffix_sums(token_counts.length_histogram(docs, vocabulary("byte_bpe_50k.tiktoken"), pattern()))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), pattern())


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_components(table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract_text(pages, html_text.fit(pages))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def _span_sql(rules: list[tuple[str, str, str]]) -> str:
    """CTE body: (doc_id, k, s, e, m) of the matches that pass; a rule is (kind, pattern, condition on m and g)."""
    parts = []
    for k, (_, rx, ok) in enumerate(rules):
        q = rx.replace("'", "''")
        parts.append(
            f"""select doc_id, {k} as k, s, s + length(m) as e, m from (
              select doc_id, hits[i] as m, caught[i] as g,
                coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
                + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as s
              from (select *, unnest(range(1, len(hits) + 1)) as i from (
                select doc_id, regexp_extract_all(t, '{q}', 0) as hits, string_split_regex(t, '{q}') as gaps,
                  regexp_extract_all(t, '{q}', {2 if "'2'" in ok else 0}) as caught
                from texts))) where {ok}"""
        )
    return " union all ".join(parts)


def _digest_sql(rules: list[tuple[str, str, str]], base: int, extra: str = "", more: str = "") -> str:
    names = "[" + ", ".join(f"'{r[0]}'" for r in rules) + "]"
    label = f"{names}[k + 1] || ':' || cast(s as bigint) || ':' || cast(e as bigint)"
    counts = ", ".join(f"count(*) filter (k = {k}) as n_{r[0]}" for k, r in enumerate(rules[:base]))
    back = ", ".join(f"coalesce(n_{r[0]}, 0) as n_{r[0]}" for r in rules[:base])
    return f"""with texts as (select doc_id, coalesce(text, '') as t from documents),
      spans as ({_span_sql(rules)}), {more}
      got as (select doc_id, {counts}, string_agg({label}, ',' order by s, k, e) filter (k < {base}) as b,
        string_agg({label}, ',' order by s, k, e) as a {extra} from {"scored" if more else "spans"} group by doc_id)
      select texts.doc_id, {back}, sha256(coalesce(b, '')) as base_sha256, coalesce(a, '') as spans
      {", coalesce(scores, '') as scores" if more else ""} from texts left join got using (doc_id)"""


def _secret_sql() -> str:
    assign = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    rules = [
        ("assign", assign, "length(g) >= 6 and '2' = '2'"),
        ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
        ("hex", "[0-9a-f]+", "length(m) >= 24"),
        ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "true"),
        ("github", "gh[pousr]_[A-Za-z0-9]+", "length(m) >= 40"),
        ("slack", "xox[abprs]-[A-Za-z0-9-]+", "length(m) >= 20"),
    ]
    return _digest_sql(rules, 3)


def _pii_sql() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(string_split(reverse({digits}), ''),
      lambda c, i: case when i % 2 = 1 then cast(c as int) else cast(c as int) * 2 - case when cast(c as int) > 4 then 9 else 0 end end)) % 10 = 0"""
    moved = "substring(replace(m, ' ', ''), 5) || substring(replace(m, ' ', ''), 1, 4)"
    as_digits = f"array_to_string(list_transform(string_split({moved}, ''), lambda c: case when c between '0' and '9' then c else cast(ascii(c) - 55 as varchar) end), '')"
    mod = f"list_reduce(list_transform(string_split({as_digits}, ''), lambda c: cast(c as int)), lambda a, c: (a * 10 + c) % 97) = 1"
    lengths = " or ".join(f"(length(replace(m, ' ', '')) = {n} and m[1:2] = '{c}')" for c, n in pii.IBAN_LENGTHS.items())
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda x: cast(x as double))) <= 255"),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"length({digits}) between 12 and 19 and {luhn}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) between 9 and 15"),
        ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", f"{mod} and ({lengths})"),
    ]
    prior = "[" + ", ".join(str(pii.PRIOR[k]) for k in pii.KINDS) + "][k + 1]"
    def whole(words: dict[str, str]) -> str:
        return " when ".join(f"{i} then regexp_matches(around, '(?i)(?:^|[^A-Za-z0-9_])(?:{words[k]})(?:[^A-Za-z0-9_]|$)')" for i, k in enumerate(pii.KINDS))

    more = f"""scored as (select *, round(case when case k when {whole(pii.CONTEXT)} end then {prior} + (1 - {prior}) / 2 else {prior} end
        / case when case k when {whole(pii.AGAINST)} end then 2 else 1 end, 3) as score
      from (select spans.*, substring(t, cast(greatest(s - {pii.NEAR}, 0) as bigint) + 1, cast(s - greatest(s - {pii.NEAR}, 0) as bigint))
        || chr(10) || substring(t, cast(e as bigint) + 1, {pii.NEAR}) as around from spans join texts using (doc_id))),"""
    return _digest_sql(rules, pii.N_BASE, ", string_agg(cast(cast(score as double) as varchar), ',' order by s, k, e) as scores", more)


_LINE_SQL = r"""
with l as (
  select doc_id, no, line, list_distinct(list_filter(string_split_regex(lower(line), '[ \t\n\v\f\r]+'), lambda x: x <> '')) as tokens
  from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as no from documents)),
f as (select line, any_value(tokens) as tokens, min((doc_id, no)) as first from l where len(tokens) > 0 group by line),
p as (select line, unnest(tokens) as tok from f),
df as (select tok, count(*) as n from p group by tok),
ranked as (select p.line, p.tok, row_number() over (partition by p.line order by df.n, p.tok) as r from p join df using (tok)),
pre as (select ranked.line, ranked.tok from ranked join f using (line) where r <= len(tokens) - ceil(0.8 * len(tokens) - 1e-9) + 1),
cand as (select distinct a.line as x, b.line as y from pre a join pre b on a.tok = b.tok and a.line <> b.line),
hit as (select distinct x from cand join f a on a.line = x join f b on b.line = y
  where b.first < a.first and len(list_intersect(a.tokens, b.tokens)) >= 0.8 / 1.8 * (len(a.tokens) + len(b.tokens)) - 1e-9),
gone as (select l.doc_id, l.no from l join f using (line) left join hit on hit.x = l.line
  where hit.x is not null or (l.doc_id, l.no) > f.first),
agg as (select doc_id, count(*) as n, string_agg(cast(no as varchar), ',' order by no) as r from gone group by doc_id)
select d.doc_id, coalesce(len(string_split(text, chr(10))), 0) as n_lines, coalesce(n, 0) as n_removed, coalesce(r, '') as removed
from documents d left join agg using (doc_id)"""

_TOP_K_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as w from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, cast(r as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as r from s) where r <= 20"""

_NEGATIVE_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as w from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as materialized (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
    cast(list_sum(list_transform(list_zip(a.w, c.w), lambda z: z[1] * z[2])) as bigint) as score
  from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(r as integer) as rank, negative_id, positive_score, negative_score from (
  select p.*, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id) as r
  from p join s using (anchor_id)
  where not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score) where r <= 10"""

_COLLOCATION_SQL = r"""
with pieces as (select coalesce(lang, 'und') as lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as ws
  from (select lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) as piece from documents)),
one as materialized (select lang, w, count(*) as f from (select lang, unnest(ws) as w from pieces) group by all),
total as (select lang, sum(f) as n from one group by lang),
two as materialized (select lang, ws[i] as w1, ws[i + 1] as w2, count(*) as f from (select lang, ws, unnest(range(1, len(ws))) as i from pieces) group by all having count(*) >= 10),
three as materialized (select lang, ws[i] as w1, ws[i + 1] as w2, ws[i + 2] as w3, count(*) as f
  from (select lang, ws, unnest(range(1, len(ws) - 1)) as i from pieces) group by all having count(*) >= 10),
cuts as (
  select two.lang, w1 || ' ' || w2 as phrase, two.f as a, 1 as k, x.f as l, y.f as r
  from two join one x on x.lang = two.lang and x.w = w1 join one y on y.lang = two.lang and y.w = w2
  where not exists (select 1 from three t where t.lang = two.lang and (t.w1, t.w2) = (two.w1, two.w2) and 100 * t.f >= 50 * two.f)
    and not exists (select 1 from three t where t.lang = two.lang and (t.w2, t.w3) = (two.w1, two.w2) and 100 * t.f >= 50 * two.f)
  union all
  select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, x.f, y.f
  from three t join one x on x.lang = t.lang and x.w = t.w1 join two y on (y.lang, y.w1, y.w2) = (t.lang, t.w2, t.w3)
  union all
  select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, y.f, x.f
  from three t join one x on x.lang = t.lang and x.w = t.w3 join two y on (y.lang, y.w1, y.w2) = (t.lang, t.w1, t.w2)),
scored as (select *, cast(1000000::hugeint * a * a // (l::hugeint * r) as bigint) as score from cuts),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, rank, phrase, a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, score from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest) join total using (lang) where rank <= 2000"""

_EMBED_SQL = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.9),
reach(node, root) as (select vec_id, vec_id from embeddings union select links.b, reach.root from reach join links on links.a = reach.node),
comp as (select node, min(root) as c from reach group by node),
n as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(n.n, 0) as n_links, comp.c as component_id, e.vec_id = comp.c as kept
from embeddings e join comp on comp.node = e.vec_id left join n on n.a = e.vec_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_toxicity, op2_token_counts, op3_secret_scans, op4_line_dedup, op5_pii, op6_simhash, op7_bpe, op8_top_k, op9_packing, op10_embedding_dedup, op11_hard_negatives, op12_html_text, op13_collocations)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_secret_scans": _secret_sql(),
        "op4_line_dedup": _LINE_SQL,
        "op5_pii": _pii_sql(),
        "op8_top_k": _TOP_K_SQL,
        "op10_embedding_dedup": _EMBED_SQL,
        "op11_hard_negatives": _NEGATIVE_SQL,
        "op13_collocations": _COLLOCATION_SQL,
    }
