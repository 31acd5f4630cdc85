"""A query for each operator over the star-schema tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import collections as C
from .operators import bulk, dml, graph, links, maintain, query
from .operators.ranking import with_rank
from .operators.table import Table
from .plans.predicates import Op, Predicate
from .schema import Kind, ObjectType, Prop, Rule
from .sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


P = Predicate


def _eq(name: str, sql_op: str, op: Op, value: int) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return query.where(S.table(spark, d, "part"), [P("p_size", op, value)]).withColumnRenamed("_okey", "okey")

    run.__name__ = name
    register(f"SELECT p_partkey AS okey FROM part WHERE p_size {sql_op} {value}")(run)


for _name, _sql, _op in (("where_eq", "=", Op.EQ), ("where_ne", "<>", Op.NE), ("where_lt", "<", Op.LT), ("where_le", "<=", Op.LE), ("where_gt", ">", Op.GT), ("where_ge", ">=", Op.GE)):
    _eq(_name, _sql, _op, 25)


@register("SELECT o_orderkey AS okey FROM orders WHERE o_custkey >= 100 AND o_custkey < 300 AND o_orderkey <> 7")
def where_and(spark, d):
    t = S.as_links(S.table(spark, d, "orders"))
    t = Table(ObjectType("orders", (Prop("o_orderkey"), Prop("o_custkey"))), t.df)
    return query.where(t, [P("o_custkey", Op.GE, 100), P("o_custkey", Op.LT, 300), P(0, Op.NE, 7)]).withColumnRenamed("_okey", "okey")


@register("SELECT c_custkey AS okey FROM customer")
def where_all(spark, d):
    return query.where(S.table(spark, d, "customer"), []).withColumnRenamed("_okey", "okey")


@register("SELECT doc_id AS pk, quality FROM labels WHERE quality = 1 AND toxic <> 1")
def where_sparse_keys(spark, d):
    return query.matching(S.numbered(spark, d, "labels"), [P("quality", Op.EQ, 1), P("toxic", Op.NE, 1)]).select(F.col("doc_id").alias("pk"), F.col("quality").cast("int").alias("quality"))


def _orders_ints(spark, d) -> Table:
    return Table(ObjectType("orders", (Prop("o_orderkey"), Prop("o_custkey"))), S.table(spark, d, "orders").df)


@register("SELECT count(*) AS n FROM orders WHERE o_custkey >= 700")
def count_where(spark, d):
    return query.count_where(_orders_ints(spark, d), [P("o_custkey", Op.GE, 700)])


_AGG = "SELECT count(*) AS count, CAST(coalesce(sum({c}), 0) AS BIGINT) AS sum, min({c}) AS min, max({c}) AS max FROM orders WHERE {w}"


def _agg(t, prop, preds):
    return query.aggregate_int(t, prop, preds).withColumn("sum", F.col("sum").cast("bigint"))


@register(_AGG.format(c="o_custkey", w="o_orderkey < 5000"))
def aggregate_int(spark, d):
    return _agg(_orders_ints(spark, d), "o_custkey", [P(0, Op.LT, 5000)])


@register(_AGG.format(c="o_custkey", w="false"))
def aggregate_empty(spark, d):
    return _agg(_orders_ints(spark, d), "o_custkey", [P(0, Op.GT, 2**63 - 1)])


@register("SELECT CAST(sum(CAST(o_orderkey AS DECIMAL(38,0)) * 10000000000000) % 18446744073709551616 AS VARCHAR) AS sum FROM orders")
def aggregate_wrap(spark, d):
    t = _orders_ints(spark, d)
    wide = Prop("big", Kind.INT, wide=True)
    big = t.df.withColumn("big", (F.col("o_orderkey").cast("decimal(20,0)") * F.lit(10**13).cast("decimal(16,0)")).cast("decimal(20,0)"))
    return query.aggregate_int(Table(t.otype.with_property(wide), big), "big", []).select(F.col("sum").cast("string").alias("sum"))


@register("SELECT o_orderkey AS okey FROM orders WHERE o_custkey BETWEEN 100 AND 200")
def range_inclusive(spark, d):
    return query.range_inclusive(_orders_ints(spark, d), "o_custkey", 100, 200).withColumnRenamed("_okey", "okey")


@register("SELECT o_orderkey AS okey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS pos FROM orders")
def sort_by_prop(spark, d):
    t = _orders_ints(spark, d)
    return query.sort_by_prop(t, query.where(t, [], ordered=False), "o_custkey", position="pos").withColumnRenamed("_okey", "okey")


@register("SELECT o_orderkey AS pk, o_custkey AS link FROM orders WHERE o_orderkey IN (77, 78, 999999999)")
def get_by_pk(spark, d):
    return query.get_by_pk(S.table(spark, d, "orders"), [77, 78, 999999999]).select(F.col("o_orderkey").alias("pk"), F.col("o_custkey").alias("link"))


@register("SELECT o_orderkey AS okey, o_orderstatus AS status FROM orders WHERE o_orderkey = 5")
def get_by_okey(spark, d):
    return query.get_by_okey(S.table(spark, d, "orders"), [5]).select(F.col("_okey").alias("okey"), F.col("o_orderstatus").alias("status"))


@register("SELECT doc_id AS pk, row_number() OVER (ORDER BY doc_id) - 1 AS okey FROM labels")
def pk_to_okey(spark, d):
    return S.numbered(spark, d, "labels").df.select(F.col("doc_id").alias("pk"), F.col("_okey").alias("okey"))


@register("SELECT o_orderkey AS pk, o_custkey + 1 AS cell FROM orders WHERE o_orderkey IN (3, 4)")
def resolve_prop(spark, d):
    return query.resolve_prop(S.table(spark, d, "orders"), [3, 4], "o_custkey")


@register("SELECT (SELECT count(*) FROM customer) AS n, (SELECT max(c_custkey) FROM customer) AS max_pk")
def live_count(spark, d):
    t = S.table(spark, d, "customer")
    return query.live_count(t).crossJoin(query.max_key(t))  # one row each


@register("SELECT quality AS value, count(*) AS n, min(k) AS min_okey, max(k) AS max_okey FROM (SELECT quality, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM labels) GROUP BY quality")
def value_index(spark, d):
    return query.value_index(S.numbered(spark, d, "labels"), "quality").withColumn("value", F.col("value").cast("int"))


@register("SELECT doc_id AS pk, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def blob_size(spark, d):
    return S.table(spark, d, "documents").df.select(F.col("doc_id").alias("pk"), C.blob_size(F.col("text")).alias("bytes"))


# links


def _holes(spark, d) -> Table:
    """Orders whose link is unset where the key is a multiple of 10."""
    t = S.table(spark, d, "orders")
    return Table(t.otype, t.df.withColumn("o_custkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey"))))


_HOLES = "(SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS link FROM orders)"


@register(f"SELECT o_orderkey AS pk, coalesce(link + 1, 0) AS raw FROM {_HOLES} WHERE coalesce(link + 1, 0) < 50")
def link_raw(spark, d):
    t = _holes(spark, d)
    return query.matching(t, [P("o_custkey", Op.LT, 50)]).select(F.col("o_orderkey").alias("pk"), query.raw(t.otype.prop("o_custkey")).alias("raw"))


@register(f"SELECT o_orderkey AS okey FROM {_HOLES} WHERE link IS NULL")
def link_unset(spark, d):
    return query.where(_holes(spark, d), [P("o_custkey", Op.EQ, 0)]).withColumnRenamed("_okey", "okey")


@register(f"SELECT o_orderkey AS okey, link AS target FROM {_HOLES}")
def get_link(spark, d):
    return links.get_link(_holes(spark, d), "o_custkey").withColumnRenamed("_okey", "okey")


@register(f"SELECT o_orderkey AS okey, {S.CUSTOMER} AS target_type, link AS target FROM {_HOLES} WHERE link IS NOT NULL")
def resolve_link(spark, d):
    return links.resolve_link(_holes(spark, d), "o_custkey").withColumnRenamed("_okey", "okey")


@register(f"SELECT o_orderkey AS pk, c_name AS name FROM {_HOLES} LEFT JOIN customer ON link = c_custkey")
def get_linked(spark, d):
    return links.follow(_holes(spark, d), "o_custkey", S.table(spark, d, "customer")).select(F.col("o_orderkey").alias("pk"), F.col("to_c_name").alias("name"))


@register("SELECT o_orderkey AS pk, c_name AS customer, n_name AS nation, r_name AS region FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def nested_linked(spark, d):
    t = S.table(spark, d, "orders")
    for name, target, link in (("customer", "customer", "o_custkey"), ("nation", "nation", "c_nationkey"), ("region", "region", "n_regionkey")):
        there = S.table(spark, d, target)
        df = links.follow(Table(ObjectType("o", (Prop("o_orderkey"), Prop(link, Kind.LINK))), t.df), link, there, f"{name}_")
        names = [c for c in df.columns if not c.startswith(f"{name}_")]
        t = Table(t.otype, df.select(*names, *(F.col(f"{name}_{c}").alias(c) for c in there.otype.names)))
    return t.df.select(F.col("o_orderkey").alias("pk"), F.col("c_name").alias("customer"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@register(f"SELECT c_custkey AS okey, count(link) AS n FROM customer LEFT JOIN {_HOLES} ON link = c_custkey GROUP BY c_custkey")
def backlink_count(spark, d):
    return links.backlink_counts(_holes(spark, d), "o_custkey", S.table(spark, d, "customer")).withColumnRenamed("_okey", "okey")


@register(f"SELECT link AS target, o_orderkey AS source FROM {_HOLES} WHERE link IS NOT NULL")
def backlink_collect(spark, d):
    return links.backlinks(_holes(spark, d), "o_custkey", ordered=True)


_CHANGE = "(SELECT o_orderkey AS pk, o_custkey AS old, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey - o_custkey % 2 END AS link FROM orders)"


@register(f"SELECT pk, link, CAST(3 AS BIGINT) AS version FROM {_CHANGE} WHERE link IS DISTINCT FROM old")
def set_link(spark, d):
    t = S.table(spark, d, "orders")
    wanted = t.df.select(F.col("o_orderkey").alias("pk"), F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey - o_custkey % 2 END").alias("target"))
    return links.set_link(t, "o_custkey", wanted, 3).select(F.col("o_orderkey").alias("pk"), F.col("o_custkey").alias("link"), F.col("_version").alias("version"))


@register("SELECT l_orderkey AS okey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey")
def link_set_count(spark, d):
    return links.link_set_counts(S.order_parts(spark, d), "parts").withColumnRenamed("_okey", "okey")


@register("SELECT l_orderkey AS okey, bool_or(l_partkey = 7) AS contains FROM lineitem GROUP BY l_orderkey")
def link_set_contains(spark, d):
    return links.link_set_contains(S.order_parts(spark, d), "parts", 7).withColumnRenamed("_okey", "okey")


@register("SELECT DISTINCT l_orderkey AS okey, l_partkey AS target FROM lineitem")
def link_set_collect(spark, d):
    return links.link_set_members(S.order_parts(spark, d), "parts").withColumnRenamed("_okey", "okey")


def _after(t: Table, prop: str, changes: DataFrame) -> DataFrame:
    out = t.apply(changes)
    return out.select(F.col("_okey").alias("okey"), F.col("_version").alias("version"), F.explode_outer(prop).alias("target"))


_SETS = "(SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)"


@register(f"SELECT s.o AS okey, CASE WHEN h.o IS NULL THEN 3 ELSE 2 END::BIGINT AS version, s.p AS target FROM (SELECT o, p FROM {_SETS} UNION SELECT DISTINCT o, 7 FROM {_SETS}) s LEFT JOIN (SELECT o FROM {_SETS} WHERE p = 7) h USING (o)")
def link_set_add(spark, d):
    t = S.order_parts(spark, d)
    wanted = t.df.select(F.col("_okey").alias("pk"), F.lit(7).cast("bigint").alias("target"))
    return _after(t, "parts", links.link_set_add(t, "parts", wanted, 3))


@register(f"SELECT a.o AS okey, CASE WHEN h.o IS NULL THEN 2 ELSE 3 END::BIGINT AS version, r.p AS target FROM (SELECT DISTINCT o FROM {_SETS}) a LEFT JOIN (SELECT o, p FROM {_SETS} WHERE p <> 7) r USING (o) LEFT JOIN (SELECT o FROM {_SETS} WHERE p = 7) h USING (o)")
def link_set_remove(spark, d):
    t = S.order_parts(spark, d)
    wanted = t.df.select(F.col("_okey").alias("pk"), F.lit(7).cast("bigint").alias("target"))
    return _after(t, "parts", links.link_set_remove(t, "parts", wanted, 3))


# collections


def _users(spark, d) -> DataFrame:
    return S.user_events(spark, d).df


_LISTS = "(SELECT user_id AS pk, list(event_id ORDER BY event_id) AS l FROM events GROUP BY user_id)"


@register(f"SELECT pk, len(l) AS n, l[3] AS third FROM {_LISTS} WHERE len(l) > 2")
def list_get(spark, d):
    return _users(spark, d).where(F.size("events") > 2).select(F.col("user_id").alias("pk"), C.length(F.col("events")).alias("n"), C.list_get(F.col("events"), 2).alias("third"))


def _items(df: DataFrame, c) -> DataFrame:
    return df.select(F.col("user_id").alias("pk"), F.posexplode(c).alias("idx", "value")).withColumn("idx", F.col("idx").cast("bigint"))


@register(f"SELECT pk, unnest(generate_series(0, len(l))) AS idx, unnest(list_append(l, 42)) AS value FROM {_LISTS}")
def list_append(spark, d):
    return _items(_users(spark, d), C.list_append(F.col("events"), F.lit(42).cast("bigint")))


@register(f"SELECT pk, idx, CASE WHEN idx = 0 THEN 42 ELSE value END AS value FROM (SELECT pk, unnest(generate_series(0, len(l) - 1)) AS idx, unnest(l) AS value FROM {_LISTS})")
def list_set(spark, d):
    return _items(_users(spark, d), C.list_set(F.col("events"), 0, F.lit(42).cast("bigint")))


_KINDS = "(SELECT DISTINCT user_id AS pk, event_type AS kind FROM events)"


@register(f"SELECT pk, count(*) AS n, bool_or(kind = 'click') AS has_click FROM {_KINDS} GROUP BY pk")
def set_read(spark, d):
    return _users(spark, d).select(F.col("user_id").alias("pk"), C.length(F.col("types")).alias("n"), C.set_contains(F.col("types"), F.lit(b"click")).alias("has_click"))


def _kinds(df: DataFrame, c) -> DataFrame:
    return df.select(F.col("user_id").alias("pk"), F.explode(c).alias("kind")).withColumn("kind", F.col("kind").cast("string"))


@register(f"SELECT pk, kind FROM {_KINDS}")
def set_collect(spark, d):
    return _kinds(_users(spark, d), F.col("types"))


@register(f"SELECT pk, kind FROM {_KINDS} UNION SELECT pk, 'click' FROM {_KINDS}")
def set_add(spark, d):
    return _kinds(_users(spark, d), C.set_add(F.col("types"), F.lit(b"click")))


@register(f"SELECT pk, kind FROM {_KINDS} WHERE kind <> 'click'")
def set_remove(spark, d):
    return _kinds(_users(spark, d), C.set_remove(F.col("types"), F.lit(b"click")))


@register("SELECT doc_id AS pk, unnest(list_sort(list_distinct([quality, toxic, 1]))) AS member FROM labels")
def set_int_build(spark, d):
    t = S.read(spark, d, "labels")
    return t.select(F.col("doc_id").alias("pk"), F.explode(C.build_set(F.array("quality", "toxic", F.lit(1)))).alias("member"))


_COUNTS = "(SELECT user_id AS pk, event_type AS kind, count(*) AS n FROM events GROUP BY ALL)"


@register(f"SELECT pk, count(*) AS keys, max(CASE WHEN kind = 'click' THEN n END) AS clicks FROM {_COUNTS} GROUP BY pk")
def dict_get(spark, d):
    m = F.col("counts")
    return _users(spark, d).select(F.col("user_id").alias("pk"), C.dict_count(m).alias("keys"), C.dict_get(m, F.lit(b"click")).alias("clicks"))


def _entries(df: DataFrame, c) -> DataFrame:
    return df.select(F.col("user_id").alias("pk"), F.explode(C.dict_entries(c)).alias("e")).select("pk", F.col("e.key").cast("string").alias("kind"), F.col("e.value").alias("n"))


@register(f"SELECT pk, kind, n FROM {_COUNTS}")
def dict_collect(spark, d):
    return _entries(_users(spark, d), F.col("counts"))


@register(f"SELECT pk, kind, n FROM {_COUNTS} WHERE kind <> 'click' UNION ALL SELECT DISTINCT pk, 'click', 9 FROM {_COUNTS}")
def dict_put(spark, d):
    return _entries(_users(spark, d), C.dict_put(F.col("counts"), F.lit(b"click"), F.lit(9).cast("bigint")))


@register(f"SELECT pk, kind, n FROM {_COUNTS} WHERE kind <> 'click'")
def dict_remove(spark, d):
    return _entries(_users(spark, d), C.dict_remove(F.col("counts"), F.lit(b"click")))


@register("SELECT doc_id AS pk, quality AS key, toxic + 10 AS value FROM labels WHERE quality <> toxic UNION ALL SELECT doc_id, quality, toxic + 10 FROM labels WHERE quality = toxic UNION ALL SELECT doc_id, 1 - quality, 5 FROM labels")
def dict_build(spark, d):
    t = S.read(spark, d, "labels")
    key = lambda c: F.col(c).cast("string").cast("binary")
    t = t.withColumn("other", 1 - F.col("quality")).withColumn("first", F.lit(3)).withColumn("five", F.lit(5)).withColumn("ten", F.col("toxic") + 10)
    m = C.build_dict(F.array(key("quality"), key("other"), key("quality")), F.array("first", "five", "ten"))
    return t.select(F.col("doc_id").alias("pk"), F.explode(m).alias("k", "v")).select("pk", F.col("k").cast("string").cast("int").alias("key"), F.col("v").cast("int").alias("value"))


# rows


def _batch(spark, d) -> DataFrame:
    """Every second customer, one unknown key for each, and every tenth twice."""
    c = S.read(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("k"), "c_name", "c_nationkey", "c_mktsegment")
    old = c.where("k % 2 = 0").select("k", F.col("k").alias("_pos"), "c_name", "c_nationkey", "c_mktsegment")
    new = old.withColumn("k", F.col("k") + 1_000_000_000).withColumn("_pos", F.col("k"))
    twice = new.where("k % 10 = 0").withColumn("_pos", F.col("_pos") + 5_000_000_000)
    return old.unionAll(new).unionAll(twice).withColumnRenamed("k", "c_custkey")


def _customers(spark, d) -> Table:
    t = S.table(spark, d, "customer")
    return Table(t.otype, t.df, 2_000_000_000, 0)


@register("""WITH o AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0)
SELECT k AS pk, 'duplicate' AS status, NULL::BIGINT AS okey FROM o
UNION ALL SELECT k + 1000000000, 'ok', 2000000000 + row_number() OVER (ORDER BY k) - 1 FROM o
UNION ALL SELECT k + 1000000000, 'duplicate', NULL FROM o WHERE k % 10 = 0""")
def insert_status(spark, d):
    return dml.insert(_customers(spark, d), _batch(spark, d), 3).status


@register("""WITH o AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0)
SELECT k AS pk, CASE WHEN k % 4 = 0 THEN 'ok' ELSE 'conflict' END AS status, CASE WHEN k % 4 = 0 THEN 3 ELSE 2 END::BIGINT AS current_version FROM o
UNION ALL SELECT k + 1000000000, 'not_found', NULL FROM o
UNION ALL SELECT k + 1000000000, 'not_found', NULL FROM o WHERE k % 10 = 0""")
def update_status(spark, d):
    batch = _batch(spark, d).withColumn("expected_version", F.when(F.col("c_custkey") % 4 == 0, 2).otherwise(9))
    return dml.update(_customers(spark, d), batch, 3).status


@register("SELECT c_custkey AS pk, CASE WHEN c_custkey % 4 = 0 THEN 'X' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE 2 END::BIGINT AS version FROM customer")
def update_apply(spark, d):
    t = S.table(spark, d, "customer")
    t = Table(ObjectType("customer", t.otype.props[:1]), t.df.select("_okey", "_version", "c_custkey", "c_mktsegment"))
    t = Table(ObjectType("customer", (*t.otype.props, Prop("c_mktsegment", Kind.BLOB))), t.df.withColumn("c_mktsegment", F.col("c_mktsegment").cast("binary")))
    batch = t.df.where("c_custkey % 4 = 0").select("c_custkey", F.lit("X").cast("binary").alias("c_mktsegment"), F.lit(2).alias("expected_version"))
    out = t.apply(dml.update(t, batch, 3).changes)
    return out.select(F.col("c_custkey").alias("pk"), F.col("c_mktsegment").cast("string").alias("segment"), F.col("_version").alias("version"))


@register("""WITH o AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0)
SELECT k AS pk, CASE WHEN k % 4 = 0 THEN 'ok' ELSE 'conflict' END AS status, CASE WHEN k % 4 = 0 THEN NULL ELSE 2 END::BIGINT AS current_version FROM o
UNION ALL SELECT k + 1000000000, 'not_found', NULL FROM o
UNION ALL SELECT k + 1000000000, 'not_found', NULL FROM o WHERE k % 10 = 0""")
def delete_status(spark, d):
    batch = _batch(spark, d).select(F.col("c_custkey").alias("pk"), F.when(F.col("c_custkey") % 4 == 0, 2).otherwise(9).alias("expected_version"), "_pos")
    return dml.delete(_customers(spark, d), batch).status


# graph


def _world(spark, d, cascade: bool = False, block: bool = False) -> list[Table]:
    """region, nation, customer, orders. Cascade: a nation owns its customers and a customer its orders, as to-many links."""
    t = [S.table(spark, d, n) for n in ("region", "nation", "customer", "orders")]
    if block:
        p = t[1].otype.props
        t[1] = Table(ObjectType("nation", (p[0], p[1], S._l("n_regionkey", S.REGION, Rule.BLOCK))), t[1].df)
    if cascade:
        for owner, child, link in ((1, 2, "c_nationkey"), (2, 3, "o_custkey")):
            kids = t[child].df.groupBy(F.col(link).alias("_okey")).agg(F.array_sort(F.collect_list("_okey")).alias("kids"))  # sizes are those of the children, a test's owners
            df = t[owner].df.join(kids, "_okey", "left").withColumn("kids", F.coalesce("kids", F.array().cast("array<bigint>")))
            t[owner] = Table(t[owner].otype.with_property(Prop("kids", Kind.LINK_SET, target=child, rule=Rule.CASCADE)), df)
    return t


def _keys(spark, d, name: str, where: str) -> DataFrame:
    t = S.table(spark, d, name)
    return t.df.where(where).select(F.col(t.otype.pk).alias("pk"), F.lit(2).cast("bigint").alias("expected_version"))


@register("SELECT n_nationkey::BIGINT AS pk, CASE WHEN n_regionkey <> 1 THEN n_regionkey END::BIGINT AS link, CAST(2 AS BIGINT) AS version FROM nation")
def delete_nullify(spark, d):
    w = _world(spark, d)
    done = graph.delete_graph(w, S.REGION, _keys(spark, d, "region", "r_regionkey = 1"))
    return w[1].apply(done.changes[1]).select(F.col("n_nationkey").alias("pk"), F.col("n_regionkey").alias("link"), F.col("_version").alias("version"))


@register("SELECT o_orderkey AS pk FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 3")
def delete_cascade(spark, d):
    w = _world(spark, d, cascade=True)
    done = graph.delete_graph(w, S.NATION, _keys(spark, d, "nation", "n_nationkey = 3"))
    return w[3].apply(done.changes[3]).select(F.col("o_orderkey").alias("pk"))


@register("SELECT r_regionkey::BIGINT AS pk, CASE WHEN EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey) THEN 'blocked' ELSE 'ok' END AS status FROM region")
def delete_block(spark, d):
    w = _world(spark, d, block=True)
    return graph.delete_graph(w, S.REGION, _keys(spark, d, "region", "true")).status.select("pk", "status")


def _owners(spark, d) -> list[Table]:
    """Customers that own a child: child k belongs to customer k, for two customers of three."""
    c = S.table(spark, d, "customer").df
    owner = ObjectType("owner", (Prop("pk"), Prop("child", Kind.LINK, target=1, rule=Rule.CASCADE)))
    child = ObjectType("child", (Prop("pk"), Prop("note")), embedded=True)
    o = c.select("_okey", "_version", F.col("c_custkey").alias("pk"), F.when(F.col("c_custkey") % 3 != 0, F.col("_okey")).alias("child"))
    k = c.where("c_custkey % 3 <> 0").select("_okey", "_version", F.col("c_custkey").alias("pk"), F.col("c_nationkey").alias("note"))
    return [Table(owner, o, 10**15, 0), Table(child, k, 10**15, 0)]


@register("SELECT c_custkey AS owner, CASE WHEN c_custkey % 7 = 0 THEN 99 WHEN c_custkey % 3 <> 0 THEN c_nationkey END::BIGINT AS note FROM customer")
def embedded_replace(spark, d):
    w = _owners(spark, d)
    batch = w[0].df.where("pk % 7 = 0").select(F.col("pk").alias("owner_pk"), (F.col("pk") + 1_000_000_000_000).alias("pk"), F.lit(99).cast("bigint").alias("note"))
    _, now = graph.insert_embedded(w, 0, "child", batch, 3)
    return links.follow(now[0], "child", now[1]).select(F.col("pk").alias("owner"), F.col("to_note").alias("note"))


@register("SELECT c_custkey AS owner, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 THEN c_nationkey END::BIGINT AS note FROM customer")
def embedded_clear(spark, d):
    w = _owners(spark, d)
    done = graph.clear_embedded(w, 0, "child", w[0].df.where("pk % 7 = 0").select(F.col("pk").alias("owner_pk")))
    now = graph.applied(w, done.changes)
    return links.follow(now[0], "child", now[1]).select(F.col("pk").alias("owner"), F.col("to_note").alias("note"))


# bulk, schema, upkeep


@register("SELECT doc_id AS pk, row_number() OVER (ORDER BY doc_id) - 1 + 100 AS okey, CAST(2 AS BIGINT) AS version FROM labels")
def bulk_import(spark, d):
    t = S.numbered(spark, d, "labels")
    empty = Table(t.otype, t.df.limit(0), 100, 0)
    return bulk.bulk_import(empty, t.df.select(*t.otype.names), 2).select(F.col("doc_id").alias("pk"), F.col("_okey").alias("okey"), F.col("_version").alias("version"))


@register("SELECT doc_id + 1000000 AS pk, row_number() OVER (ORDER BY doc_id) - 1 + (SELECT count(*) FROM labels) AS okey FROM labels")
def bulk_append(spark, d):
    t = S.numbered(spark, d, "labels")
    plain = ObjectType("labels", tuple(Prop(n) for n in t.otype.names))
    rows = t.df.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "quality", "toxic", F.col("_okey").alias("_pos"))
    return bulk.bulk_append(Table(plain, t.df, t.df.count(), 1), rows, 3).select(F.col("doc_id").alias("pk"), F.col("_okey").alias("okey"))


@register("SELECT doc_id + 1000000 AS pk, (SELECT count(*) FROM labels) + row_number() OVER (ORDER BY doc_id DESC) - 1 AS okey FROM labels")
def bulk_append_fallback(spark, d):
    t = S.numbered(spark, d, "labels")
    rows = t.df.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "quality", "toxic", (-F.col("_okey")).alias("_pos"))
    return bulk.bulk_append_or_insert(Table(t.otype, t.df, t.df.count(), 1), rows, 3).select(F.col("doc_id").alias("pk"), F.col("_okey").alias("okey"))


@register("SELECT c_custkey AS pk, CAST(7 AS BIGINT) AS added, CAST(0 AS BIGINT) AS members FROM customer")
def add_property(spark, d):
    t = maintain.add_property(S.table(spark, d, "customer"), Prop("added"), F.lit(7))
    t = maintain.add_property(t, Prop("tags", Kind.SET))
    return t.df.select(F.col("c_custkey").alias("pk"), "added", C.length(F.col("tags")).alias("members"))


@register("SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, c_mktsegment FROM customer")
def remove_property(spark, d):
    t = maintain.remove_property(S.table(spark, d, "customer"), 1)
    return t.df.select(*t.otype.names)


@register("SELECT count(*) FILTER (o_orderkey % 3 = 0) AS live, count(*) AS next_row, (count(*) - count(*) FILTER (o_orderkey % 3 = 0)) * 2 > count(*) AS should_compact FROM orders")
def should_compact(spark, d):
    t = S.table(spark, d, "orders")
    live, n = t.df.where("o_orderkey % 3 = 0").count(), t.df.count()
    return spark.createDataFrame([(live, n, maintain.should_compact(live, n))], "live bigint, next_row bigint, should_compact boolean")


@register("SELECT o_orderkey AS okey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row FROM orders WHERE o_orderkey % 3 = 0")
def compact(spark, d):
    t = S.table(spark, d, "orders")
    dense = maintain.compact(Table(t.otype, t.df.where("o_orderkey % 3 = 0"), 0, 1))
    return with_rank(dense.df.select("_okey"), "_okey", name="row").select(F.col("_okey").alias("okey"), "row")


@register("SELECT count(*) AS n, sum(o_orderkey)::VARCHAR AS sum FROM orders")
def pk_fold(spark, d):
    return maintain.pk_fold(S.table(spark, d, "orders")).select("n", F.col("sum").cast("string").alias("sum"))


@register("""SELECT 3 AS type, 'dangling link o_custkey' AS problem, count(*) AS n FROM orders WHERE o_custkey % 100 = 0 HAVING count(*) > 0""")
def integrity(spark, d):
    w = _world(spark, d)
    w = [Table(t.otype, t.df, 10**15, 0) for t in w]
    w[2] = Table(w[2].otype, w[2].df.where("_okey % 100 <> 0"), 10**15, 0)
    return maintain.integrity_report(w)


def _store(spark):
    """A new store in the shared folder."""
    from .operators.cut import scratch
    from .sources.store import Store

    return Store.create(spark, scratch(spark))


def _committed(spark, d, commits: int = 3):
    """All orders in `commits` commits, each with the next stretch of keys; the store and the versions."""
    t = S.table(spark, d, "orders")
    top, store, versions = t.df.agg(F.max("o_orderkey")).first()[0], _store(spark), []
    store.set_retain_versions(10)
    for k in range(commits):
        with store.begin_write() as txn:
            if k == 0:
                txn.add_type(ObjectType("orders", (Prop("o_orderkey"), Prop("o_custkey"))))
            part = t.df.where(f"o_orderkey * {commits} div {top + 1} = {k}")
            txn.bulk_append(0, part.select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("_pos")))
            versions.append(txn.version)
            txn.commit()
    return store, versions


@register("SELECT o_orderkey AS pk, o_custkey + 1 AS raw FROM orders WHERE o_orderkey * 3 // (SELECT max(o_orderkey) + 1 FROM orders) = 0")
def time_travel(spark, d):
    """Three commits to a store in the shared folder, read at the first of them."""
    store, versions = _committed(spark, d)
    return store.read_at(versions[0]).table(0).df.select(F.col("o_orderkey").alias("pk"), (F.col("o_custkey") + 1).alias("raw"))


@register("SELECT o_orderkey * 3 // (SELECT max(o_orderkey) + 1 FROM orders) AS commit, sum(count(*)) OVER (ORDER BY o_orderkey * 3 // (SELECT max(o_orderkey) + 1 FROM orders))::BIGINT AS live FROM orders GROUP BY 1")
def live_counts_by_version(spark, d):
    """Live rows of each version, from the manifests alone."""
    store, versions = _committed(spark, d)
    return spark.createDataFrame([(k, store.read_at(v).live_count(0)) for k, v in enumerate(versions)], "commit bigint, live bigint")


@register("SELECT c_custkey AS pk, c_nationkey::BIGINT AS nation, CASE WHEN c_custkey % 5 = 0 THEN 8 ELSE 7 END::BIGINT AS added FROM customer WHERE c_custkey % 4 <> 1")
def store_migration(spark, d):
    """A store that gains a property, loses one, is changed and thinned out, compacted to another place and checked to be the same there."""
    c, store = S.table(spark, d, "customer").df, _store(spark)
    with store.begin_write() as w:
        w.add_type(ObjectType("customer", (Prop("pk"), Prop("gone"), Prop("nation"))))
        w.bulk_import(0, c.select(F.col("c_custkey").alias("pk"), F.lit(3).cast("bigint").alias("gone"), F.col("c_nationkey").alias("nation")))
        w.commit()
    with store.begin_write() as w:
        w.add_property(0, Prop("added"), 7)
        w.remove_property(0, 1)
        w.update(0, c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("pk"), F.col("c_nationkey").alias("nation"), F.lit(8).cast("bigint").alias("added"), F.lit(None).cast("bigint").alias("expected_version"), F.col("c_custkey").alias("_pos")))
        w.delete(0, c.where("c_custkey % 4 = 1").select(F.col("c_custkey").alias("pk"), F.lit(None).cast("bigint").alias("expected_version"), F.col("c_custkey").alias("_pos")))
        w.commit()
    copy = store.compact_to(f"{store.path}-copy")
    with store.begin_read() as a, copy.begin_read() as b:
        maintain.verify_equivalent(a.tables(), b.tables())
    if not copy.verify_integrity().isEmpty():
        raise ValueError("the copy has problems")
    return copy.begin_read().table(0).df.select("pk", "nation", "added")


@register("SELECT c_custkey AS pk, CASE WHEN c_custkey > 1 AND (c_custkey - 1) % 3 <> 0 THEN c_custkey - 1 END AS prev FROM customer WHERE c_custkey % 3 <> 0")
def delete_same_type(spark, d):
    """Customers linked to the one before; a third of them is deleted, and links to them are cleared."""
    c = S.table(spark, d, "customer").df
    first = c.agg(F.min("_okey")).first()[0]
    t = Table(ObjectType("customer", (Prop("pk"), Prop("prev", Kind.LINK, target=0))), c.select("_okey", "_version", F.col("c_custkey").alias("pk"), F.when(F.col("_okey") > first, F.col("_okey") - 1).alias("prev")))
    done = graph.delete_graph([t], 0, t.df.where("pk % 3 = 0").select("pk", F.lit(None).cast("bigint").alias("expected_version")))
    return t.apply(done.changes[0]).select("pk", "prev")


@register("SELECT doc_id AS pk, 2 + (quality <> toxic)::BIGINT - 1 AS n, quality = 1 OR toxic = 1 AS has_one, quality = 0 OR toxic = 0 AS has_zero, list_sort(list_distinct([quality, toxic, 9]))::VARCHAR AS after_add, list_filter([0, 1], lambda x: x <> 1 AND (x = quality OR x = toxic))::VARCHAR AS after_remove FROM labels")
def set_int_change(spark, d):
    m = C.build_set(F.array(F.col("quality").cast("bigint"), F.col("toxic").cast("bigint")))
    text = lambda c: F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))
    t = S.read(spark, d, "labels").select(F.col("doc_id").alias("pk"), m.alias("m"))
    one, zero, nine = (F.lit(v).cast("bigint") for v in (1, 0, 9))
    return t.select("pk", C.length(F.col("m")).alias("n"), C.set_contains(F.col("m"), one).alias("has_one"), C.set_contains(F.col("m"), zero).alias("has_zero"), text(C.set_add(F.col("m"), nine)).alias("after_add"), text(C.set_remove(F.col("m"), one)).alias("after_remove"))


@register("SELECT p_partkey AS pk, 3 AS n, p_name AS first, unnest(['x' || p_name, p_size::VARCHAR, p_name, 'end']) AS item, unnest([0, 1, 2, 3]) AS idx FROM part")
def list_blob_change(spark, d):
    """A list of blobs, built, appended to and changed in place."""
    t = S.read(spark, d, "part")
    blob = lambda c: c.cast("string").cast("binary")
    t = t.select(F.col("p_partkey").alias("pk"), "p_name", C.build_list(blob(F.col("p_name")), blob(F.col("p_size")), blob(F.col("p_name"))).alias("l"))
    new = C.list_set(C.list_append(F.col("l"), F.lit(b"end")), 0, blob(F.concat(F.lit("x"), "p_name")))
    t = t.select("pk", C.length(F.col("l")).cast("int").alias("n"), C.list_get(F.col("l"), 0).cast("string").alias("first"), F.posexplode(new).alias("idx", "item"))
    return t.select("pk", "n", "first", F.col("item").cast("string").alias("item"), "idx")


@register("SELECT doc_id AS pk, substr(hex(encode(text)), 9, 16) AS part FROM documents")
def blob_read(spark, d):
    return S.table(spark, d, "documents").df.select(F.col("doc_id").alias("pk"), F.hex(C.blob_read(F.col("text").cast("binary"), 4, 8)).alias("part"))
