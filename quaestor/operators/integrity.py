"""Keys, references, checks, defaults, updates and deletes. Tables are immutable: a change gives new frames."""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor import schema as S


def duplicates(table: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their count; a key with nulls counts as a value, as UNIQUE does in T-SQL.

    Hashes are counted first; only rows whose hash occurs again are grouped by the values themselves, which may be whole texts.
    """
    hashed = table.withColumn("_hash", F.xxhash64(*keys))
    again = hashed.groupBy("_hash").agg(F.count("*").alias("n")).where("n > 1").select("_hash")
    return hashed.join(again, "_hash", "left_semi").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


#: Keys of new rows that are broadcast to look them up at most; more are joined by shuffle.
LOOKUP = 1_000_000


def among(keys: DataFrame, of: DataFrame) -> DataFrame:
    """The distinct keys of a table that are among the keys `of`, of the same names: the table is not shuffled where these are no more than LOOKUP."""
    wanted = of.distinct()
    few = wanted.limit(LOOKUP + 1).count() <= LOOKUP
    return keys.join(F.broadcast(wanted) if few else wanted, keys.columns, "left_semi").distinct()


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference names no parent; null references name none and pass."""
    keys = parent.select(F.col(key).alias(column)).distinct()
    return child.where(F.col(column).isNotNull()).join(keys, column, "left_anti").select(*child.columns)


def missing(table: DataFrame, name: str) -> DataFrame:
    """Rows with nulls where the schema allows none, with the columns' names."""
    marks = F.array_compact(F.array(*(F.when(F.col(c.name).isNull(), F.lit(c.name)) for c in S.columns(name) if c.required and c.name in table.columns)))
    return table.withColumn("missing", marks).where(F.size("missing") > 0)


def role_violations(roles: DataFrame) -> DataFrame:
    """Rows whose role is outside the list; a check rejects only what is false, so null passes here."""
    return roles.where(~F.col("role_name").isin(S.ROLES))


def with_defaults(table: DataFrame, name: str, key: list[str] | None = None, now: str | None = None) -> DataFrame:
    """The table in its schema, omitted and null columns filled by default.

    Generated ids are MD5 over the `key` columns, else random; times are `now`, else the current time.
    """
    from quaestor.functions.text import uid

    out = []
    for c in S.columns(name):
        have = F.col(c.name).cast(c.type) if c.name in table.columns else F.lit(None).cast(c.type)
        if c.default == "uuid()" and key:
            fill = uid(name, F.concat_ws(":", *key))
        elif c.default == "localtimestamp()" and now:
            fill = F.lit(now).cast("timestamp_ntz")
        else:
            fill = F.expr(c.default).cast(c.type) if c.default is not None else None
        out.append((have if fill is None else F.coalesce(have, fill)).alias(c.name))
    return table.select(*out)


def patch(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A partial update: values of `changes` that are not null replace the table's; keys it does not name stay.

    Of several changes to one key the largest value of each column holds, so that no row of the table is doubled.
    """
    changed = [c for c in changes.columns if c != key]
    new = changes.groupBy(key).agg(*(F.max(c).alias(f"_new_{c}") for c in changed)) if changed else changes.select(key).distinct()
    return table.join(new, key, "left").select(*(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in changed else F.col(c) for c in table.columns))


def rejections(table: DataFrame, rows: DataFrame, name: str, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """rows with `reasons`: the rules of the schema that keep each from being added to the table, an empty list if none does.

    Columns that need a value and have none; keys that the table holds already or that several rows share, under the
    primary key and the UNIQUE rules; references to parents among `tables` that are not there; roles outside the list.
    Only keys of the new rows are looked up in the table and its parents.
    """
    out = rows.withColumn("_row", F.monotonically_increasing_id())
    marks = [F.when(F.col(c.name).isNull(), F.lit(f"{c.name} missing")) for c in S.columns(name) if c.required and c.name in rows.columns]
    if name == "user_roles":
        marks.append(F.when(~F.col("role_name").isin(S.ROLES), F.lit("role_name not allowed")))
    for i, keys in enumerate([[S.columns(name)[0].name], *(k for t, k in S.UNIQUE if t == name)]):
        if not set(keys) <= set(rows.columns):
            continue
        own = F.struct(*keys)
        held = among(table.select(F.struct(*keys).alias("_key")), rows.select(own.alias("_key"))).withColumn(f"_held{i}", F.lit(True))
        again = rows.select(own.alias("_key")).groupBy("_key").agg(F.count("*").alias(f"_n{i}"))
        out = out.withColumn("_key", own).join(held, "_key", "left").join(again, "_key", "left").drop("_key")
        marks.append(F.when(F.col(f"_held{i}") | (F.col(f"_n{i}") > 1), F.lit(f"{', '.join(keys)} not unique")))
    for i, r in enumerate(r for r in S.references() if r.child == name and r.column in rows.columns and r.parent in (tables or {})):
        there = among(tables[r.parent].select(F.col(r.key).alias(r.column)), rows.select(r.column)).withColumn(f"_there{i}", F.lit(True))
        out = out.join(there, r.column, "left")
        marks.append(F.when(F.col(r.column).isNotNull() & F.col(f"_there{i}").isNull(), F.lit(f"{r.column} not among {r.parent}")))
    return out.select(*rows.columns, F.array_compact(F.array(*marks)).alias("reasons"))


def insert(table: DataFrame, rows: DataFrame, name: str, key: list[str] | None = None, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """A validated append: rows get defaults, and none may have a reason under rejections()."""
    filled = with_defaults(rows, name, key)
    bad = rejections(table, filled, name, tables).where(F.size("reasons") > 0).select("reasons").limit(1).collect()
    if bad:
        raise ValueError(f"{name}: {'; '.join(bad[0]['reasons'])}")
    return table.unionByName(filled)


def insert_from_select(source: DataFrame, rows: list[tuple[str, dict]], match: str) -> DataFrame:
    """Rows made of source rows whose `match` equals a value, with literals added, as one union."""
    out = None
    for value, literals in rows:
        part = source.where(F.col(match) == value).select("*", *(F.lit(v).alias(k) for k, v in literals.items()))
        out = part if out is None else out.unionByName(part)
    return out


def rows_gone(tables: Mapping[str, DataFrame], name: str, ids: DataFrame) -> dict[str, DataFrame]:
    """The primary keys of the rows that go with the named ones: theirs, and those of children that cascades take along."""
    gone: dict[str, DataFrame] = {name: ids.select(F.col(ids.columns[0]).alias(S.columns(name)[0].name)).distinct()}
    line, by_parent = deque([name]), {}
    for r in S.references():
        if r.child in tables:
            by_parent.setdefault(r.parent, []).append(r)
    while line:
        parent = line.popleft()
        for r in by_parent.get(parent, []):
            if r.rule == "C":
                key = S.columns(r.child)[0].name
                more = tables[r.child].join(gone[parent].select(F.col(r.key).alias(r.column)), r.column, "left_semi").select(key)
                gone[r.child] = gone[r.child].unionByName(more).distinct() if r.child in gone else more.distinct()
                if r.child != parent:
                    line.append(r.child)
    return gone


def delete(tables: Mapping[str, DataFrame], name: str, ids: DataFrame) -> tuple[dict[str, DataFrame], dict[tuple[str, str], DataFrame]]:
    """Deletes rows by primary key and follows references: returns the new tables, and what blocks the delete.

    Cascades take along the rows of children, set-null clears their reference. Rows that a rule of no action keeps,
    and whose parent would go while they stay, block it: (child, column) to those rows. The caller decides.
    """
    gone = rows_gone(tables, name, ids)
    left, blocked = {}, {}
    for t, rows in tables.items():
        left[t] = rows.join(gone[t], S.columns(t)[0].name, "left_anti").select(*rows.columns) if t in gone else rows
    for r in S.references():
        if r.child in left and r.parent in gone:
            keys = gone[r.parent].select(F.col(r.key).alias(r.column))
            if r.rule == "N":
                marked = left[r.child].join(keys.withColumn("_gone", F.lit(True)), r.column, "left")
                left[r.child] = marked.withColumn(r.column, F.when(F.col("_gone").isNull(), F.col(r.column))).select(*tables[r.child].columns)
            elif r.rule == "R":
                blocked[r.child, r.column] = left[r.child].join(keys, r.column, "left_semi")
    return left, blocked
