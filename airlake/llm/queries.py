"""The operators of this subpackage on their whole tables, as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlake.catalog.base import Catalog
from airlake.llm.common import table

catalog = Catalog()
add = catalog.add
#: Key of the registered queries; a user brings a secret one.
KEY = "registered-queries"


#: Lower case of A-Z alone, then words, in DuckDB.
_WORDS = """list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"""
OP6_SQL = f"""with d as (select doc_id, {_WORDS} as w from documents), b as (select item_id, {_WORDS} as w from benchmark),
cut as (select item_id, least(len(w), 10) as n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
  lambda i: list_slice(w, i, i + least(len(w), 10) - 1))) as terms from b where len(w) > 0),
lengths as (select distinct n from cut),
spots as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as start, w from d, lengths where len(w) >= n),
met as (select s.doc_id, s.start, c.n, c.item_id from spots s join cut c on c.n = s.n and c.terms = list_slice(s.w, s.start, s.start + s.n - 1)),
places as (select distinct doc_id, unnest(range(start, start + n)) as place from met),
hits as (select doc_id, count(*) as n_hit from places group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from met) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join found using (doc_id)"""


@add("op4_token_counts")
def op4_token_counts(spark, folder):
    import public_tokenizers

    from airlake.llm import token_counts as T

    counts = T.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > T.OVER)


@add("op9_weak_supervision")
def op9_weak_supervision(spark, folder):
    from airlake.llm import weak_rules as W

    judged = W.judge(table(spark, folder, "documents"))
    counts = "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"
    return judged.select(*counts, "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


@add("op5_feistel_pseudonyms")
def op5_feistel_pseudonyms(spark, folder):
    from airlake.llm import pii_feistel as P

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return P.pseudonymise(docs, KEY, count_col="n_values")


@add("op6_positional_index", OP6_SQL)
def op6_positional_index(spark, folder):
    from airlake.llm import decontaminate as D

    hits = D.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Wanted shares of tokens by language.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


@add("op10_soft_membership")
def op10_soft_membership(spark, folder):
    from airlake.llm import soft_mix as M

    return M.mix(table(spark, folder, "documents"), table(spark, folder, "labels"), TARGETS).drop("membership")


@add("op8_levenshtein_lexicon")
def op8_levenshtein_lexicon(spark, folder):
    from airlake.llm import toxicity as X
    from airlake.llm.common import remainder

    docs = table(spark, folder, "documents")
    scored = X.score(docs, X.learn(docs, table(spark, folder, "labels")))
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= X.THRESHOLD).cast("int").alias("predicted"),
        "exact",
        "near",
        "mentioned",
        "aimed",
    )


@add("op3_factorisation_machine")
def op3_factorisation_machine(spark, folder):
    from airlake.llm import quality_fm as Q
    from airlake.llm.common import remainder

    docs = table(spark, folder, "documents")
    scored = Q.score(docs, Q.learn(docs, table(spark, folder, "labels")))
    held_out, predicted = remainder(F.col("doc_id"), 5) == 0, (F.col("score") >= Q.THRESHOLD).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


#: Links by counting shared shingles of all pairs, and the smallest id along them.
OP7_SQL = r"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [w]
  else list_transform(range(1, len(w) - 3), lambda i: list_slice(w, i, i + 4)) end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 75 * (x.n + y.n - i)),
r as (select doc_id, doc_id as c from documents union select r.doc_id, l.b from r join links l on l.a = r.c),
c as (select doc_id, min(c) as component_id from r group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from c left join n using (doc_id)"""


@add("op7_tensored_minhash", OP7_SQL)
def op7_tensored_minhash(spark, folder):
    from airlake.llm import minhash_tensor as H

    return H.near_duplicates(table(spark, folder, "documents"))


OP1_SQL = r"""with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
t as (select doc_id, i, w[i] as b, case when i > 1 then w[i - 1] end as a from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d)),
u as (select b as word, count(*) as n from t group by b), p as (select a, b, count(*) as n from t where a is not null group by a, b),
s as (select t.doc_id, sum(case when p.n is not null then log10(p.n / ua.n) when t.a is null then log10(ub.n / (select count(*) from t))
  else log10(0.4) + log10(ub.n / (select count(*) from t)) end) as score, count(*) as n_words
  from t join u ub on ub.word = t.b left join u ua on ua.word = t.a left join p on p.a = t.a and p.b = t.b group by t.doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, round(coalesce(score, 0.0), 4) as score, round(score / n_words, 4) as mean
from d left join s using (doc_id)"""


@add("op1_stupid_backoff", OP1_SQL)
def op1_stupid_backoff(spark, folder):
    from airlake.llm import lm_score as L

    scored = L.score(table(spark, folder, "documents"), single=True)
    return scored.withColumns({c: F.round(c, 4) for c in ("score", "mean")})


@add("op2_wrapper_induction")
def op2_wrapper_induction(spark, folder):
    from airlake.llm import html_extract as X

    return X.extract(table(spark, folder, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


#: One run in so many gets a planted error.
MISSPELL = 31


@add("op13_spelling_variants")
def op13_spelling_variants(spark, folder):
    from airlake.llm import spelling as S

    return S.spelling_variants(table(spark, folder, "documents"), misspell=MISSPELL)


OP11_SQL = f"""with d as (select doc_id, {_WORDS} as w from documents), b as (select item_id, {_WORDS} as w from benchmark),
q as (select distinct item_id, unnest(w) as term from b),
n as (select doc_id, len(w) as n from d where len(w) > 0), g as (select count(*) as docs, cast(sum(n) as bigint) as total from n),
t as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from d) where term in (select term from q) group by all),
v as (select term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as weight from t, g group by term),
s as (select item_id, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total)))) as bigint) as score
  from q join v using (term) join t using (term) join n using (doc_id), g group by item_id, doc_id),
r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from s where score > 0)
select * from r where rank <= 10"""


@add("op11_hybrid_search", OP11_SQL)
def op11_hybrid_search(spark, folder):
    from airlake.llm import lexical_search as R

    return R.ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _op12_sql() -> str:
    """The index and the templates as rows; one occurrence of an indexed word joins all its postings."""
    from airlake.llm import license_scan as L

    index = L.positional_index(L.TEMPLATES)
    postings = ", ".join(f"('{p.word}', {p.template}, {p.place}, cast({p.weight} as double))" for p in index)
    rows = []
    for k, t in enumerate(L.TEMPLATES):
        own = [p.weight for p in index if p.template == k]
        keys = ", ".join(f"' {' '.join(L.plain_words(x))} '" for x in t.keys)
        rows.append(f"({k}, '{t.label}', {len(L.plain_words(t.text))}, {min(L.AGREE, len(own))}, cast({sum(own)} as double), [{keys}])")
    phrases = ", ".join(f"({L.plain_words(p)}, '{label}')" for p, label in L.NAMES)
    return f"""with d as (select doc_id, {_WORDS} as w from documents),
p(word, template, place, weight) as (values {postings}),
t(template, label, size, need, total, keys) as (values {", ".join(rows)}),
b(phrase, label) as (values {phrases}),
o as (select doc_id, i - 1 as pos, w[i] as word from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d)),
g as (select doc_id, template, pos - place as start, count(*) as n, sum(weight) as weight from o join p using (word) group by all),
v as (select g.doc_id, label, round(weight / total, 6) as share from g join t using (template) join d using (doc_id) where n >= need
  and len(list_filter(keys, lambda k: not contains(' ' || array_to_string(list_slice(w, greatest(start - {L.SLACK}, 0) + 1, start + size + {L.SLACK}), ' ') || ' ', k))) = 0),
s as (select o.doc_id, pos, label from o join b on o.word = phrase[1] join d using (doc_id) where list_slice(w, pos + 1, pos + len(phrase)) = phrase),
bs as (select doc_id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, string_agg(distinct label, ',' order by label) as base_labels from s group by doc_id),
al as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from s union select doc_id, label from v) group by doc_id),
vs as (select doc_id, max(share) as share from v group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
  coalesce(labels, '') as labels, greatest(coalesce(share, 0.0), case when n_base > 0 then {L.NAMED} else 0.0 end) as score
from d left join bs using (doc_id) left join al using (doc_id) left join vs using (doc_id)"""


OP12_SQL = _op12_sql()


@add("op12_license_scan", OP12_SQL)
def op12_license_scan(spark, folder):
    from airlake.llm import license_scan as L

    found = L.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
