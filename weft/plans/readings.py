"""Queries of labels found by dictionary, and of readings checked and repaired by grammars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary, grammar
from ..registry import query
from ..sources.io import table

_PLAIN = r"trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'))"
_LABELS = rf"""
with b as (select 'kind' || (item_id % 3) as kind, string_split({_PLAIN.format("text")}, ' ') as ws from benchmark),
l as (select kind, array_to_string(ws[1:n], ' ') as label, count(*) as n from b, (select unnest([2, 3]) as n) where len(ws) >= n group by all),
d as (select doc_id, lang, ' ' || {_PLAIN.format("coalesce(text, '')")} || ' ' as t from documents)
"""


def _opening_words(spark, sf_dir):
    """The first two and three words of each item are its labels, by kind."""
    b = table(spark, sf_dir, "benchmark").withColumn("kind", F.concat(F.lit("kind"), (F.col("item_id") % 3).cast("string")))
    ws = b.withColumn("ws", F.split(dictionary.plain(F.col("text")), " ")).withColumn("n", F.explode(F.array(F.lit(2), F.lit(3))))
    ws = ws.where(F.size("ws") >= F.col("n")).withColumn("label", F.array_join(F.slice("ws", 1, F.col("n")), " "))
    return dictionary.vocabulary(ws, "kind", "label")


@query(_LABELS + "select kind, count(*) as labels, sum(n)::bigint as rows_, min(label) as first_label, max(label) as last_label from l group by kind")
def label_vocabulary(spark, sf_dir):
    v = _opening_words(spark, sf_dir).groupBy("kind")
    return v.agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("rows_"), F.min("label").alias("first_label"), F.max("label").alias("last_label"))


@query(_LABELS + """
select kind, label, count(*) as n_documents, min(doc_id) as first_id, sum((len(t) - len(replace(t, ' ' || label || ' ', ''))) // (len(label) + 2))::bigint as places
from l join d on contains(t, ' ' || label || ' ') group by kind, label""")
def label_documents(spark, sf_dir):
    """Documents that hold each label anywhere in their text; places of one label that share a blank count once."""
    found = dictionary.find_labels(table(spark, sf_dir, "documents"), "doc_id", "text", _opening_words(spark, sf_dir), longest=False)
    n = F.size(F.split("label", " "))
    by_doc = found.groupBy("kind", "label", "id").agg(F.sort_array(F.collect_list("word")).alias("at"), F.first(n).alias("n"))
    # the SQL replaces from the left, so that of places that touch every second one is left
    state = F.struct(F.lit(-1).cast("long").alias("free"), F.lit(0).cast("long").alias("k"))
    step = lambda s, w, n: F.when(w > s["free"], F.struct((w + n).cast("long").alias("free"), (s["k"] + 1).alias("k"))).otherwise(s)
    by_doc = by_doc.withColumn("places", F.aggregate("at", state, lambda s, w: step(s, w, F.col("n")))["k"])
    return by_doc.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n_documents"), F.min("id").alias("first_id"), F.sum("places").alias("places"))


@query()
def label_spans(spark, sf_dir):
    """Places of the longest labels that overlap no earlier one, but for those in front of a stop word."""
    found = dictionary.find_labels(table(spark, sf_dir, "documents"), "doc_id", "text", _opening_words(spark, sf_dir), after=("the", "of"))
    return found.withColumnRenamed("id", "doc_id")


@query(r"""
select page_id, nullif(regexp_extract(url, '^[^?#]*/([0-9]+)([?#].*)?$', 1), '') as sheet, nullif(regexp_extract(url, '://[^/]*/([a-z]{2})/', 1), '') as kind,
  try_cast(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') as int) as level
from pages""")
def sheet_ids(spark, sf_dir):
    part = lambda pattern: F.nullif(F.regexp_extract("url", pattern, 1), F.lit(""))
    return table(spark, sf_dir, "pages").select(
        "page_id", part(r"^[^?#]*/([0-9]+)([?#].*)?$").alias("sheet"), part("://[^/]*/([a-z]{2})/").alias("kind"),
        part("[?&]page=([0-9]+)").try_cast("int").alias("level"),
    )


DIGIT = grammar.chars("0123456789")


def grammars() -> dict[str, grammar.Grammar]:
    """Codes, amounts and days as the readings below have them."""
    two = grammar.any_of(grammar.seq(grammar.chars("0"), grammar.chars("123456789")), grammar.seq(grammar.chars("1"), grammar.chars("012")))
    day = grammar.any_of(grammar.seq(grammar.chars("0"), grammar.chars("123456789")), grammar.seq(grammar.chars("12"), DIGIT), grammar.seq(grammar.chars("3"), grammar.chars("01")))
    return {
        "code": grammar.Grammar(grammar.seq(grammar.any_of(grammar.text("Customer"), grammar.text("Supplier")), grammar.text("#"), grammar.times(DIGIT, 9, 9))),
        "amount": grammar.Grammar(grammar.seq(grammar.times(DIGIT, 1), grammar.times(grammar.seq(grammar.text("."), grammar.times(DIGIT, 1, 2)), 0, 1))),
        "day": grammar.Grammar(grammar.seq(grammar.any_of(grammar.text("19"), grammar.text("20")), DIGIT, DIGIT, grammar.text("-"), two, grammar.text("-"), day)),
    }


_READINGS = """
with r as (
  select 'c' as t, c_custkey as id, c_name as reading from customer union all select 's', s_suppkey, s_name from supplier
  union all select 'o', o_orderkey, strftime(o_orderdate, '%Y-%m-%d') from orders union all select 'p', p_partkey, (p_retailprice * 10)::bigint::varchar || '.5' from part
), e as (
  select t, id, case id % 9 when 1 then replace(reading, '0', 'O') when 2 then replace(reading, '1', 'l') when 3 then reading || '7' when 4 then substr(reading, 2)
    when 5 then replace(reading, '-', '/') else reading end as reading from r
)
"""


def _readings(spark, sf_dir):
    """Names, days and amounts with planted errors."""
    of = lambda name, kind, key, reading: table(spark, sf_dir, name).select(F.lit(kind).alias("t"), F.col(key).cast("long").alias("id"), reading.alias("reading"))
    rows = of("customer", "c", "c_custkey", F.col("c_name")).unionByName(of("supplier", "s", "s_suppkey", F.col("s_name")))
    rows = rows.unionByName(of("orders", "o", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd")))
    rows = rows.unionByName(of("part", "p", "p_partkey", F.concat(F.round(F.col("p_retailprice") * 10).cast("long").cast("string"), F.lit(".5"))))
    r, k = F.col("reading"), F.col("id") % 9
    planted = F.when(k == 1, F.replace(r, F.lit("0"), F.lit("O"))).when(k == 2, F.replace(r, F.lit("1"), F.lit("l"))).when(k == 3, F.concat(r, F.lit("7")))
    return rows.withColumn("reading", planted.when(k == 4, F.substring("reading", 2, 100)).when(k == 5, F.replace(r, F.lit("-"), F.lit("/"))).otherwise(r))


@query(_READINGS + r"""
select t, case when regexp_full_match(reading, '(Customer|Supplier)#[0-9]{9}') then 'code' when regexp_full_match(reading, '[0-9]+(\.[0-9]{1,2})?') then 'amount'
  when regexp_full_match(reading, '(19|20)[0-9]{2}-(0[1-9]|1[012])-(0[1-9]|[12][0-9]|3[01])') then 'day' end as grammar, count(*) as n
from e group by 1, 2""")
def grammar_acceptance(spark, sf_dir):
    got = grammar.read_by(_readings(spark, sf_dir), "reading", grammars(), most=0)
    return got.groupBy("t", "grammar").agg(F.count(F.lit(1)).alias("n"))


@query()
def grammar_repair(spark, sf_dir):
    """Readings that no grammar accepts, with their cheapest repair."""
    return grammar.read_by(_readings(spark, sf_dir), "reading", grammars()).where("cost > 0 or cost is null")
