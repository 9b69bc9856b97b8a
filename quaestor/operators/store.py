"""The model's tables as written tables: validated appends, updates and deletes that rewrite only the partitions they touch."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor import schema as S
from quaestor.operators import integrity
from quaestor.sources import stored

#: The partition column: a hash of the primary key.
BUCKET = "bucket"


class Rejected(ValueError):
    """Rows that the schema's rules keep out, or rows that keep others from being deleted; nothing was written."""


def key_of(name: str) -> str:
    return S.columns(name)[0].name


@dataclass
class Store:
    """Tables of the model in a database, each partitioned by a hash of its primary key into `buckets` parts.

    A change reads and rewrites the partitions of the keys it names, and no others: choose `buckets` so that a partition is
    some hundred MB. Each table's change is one commit of Spark's dynamic partition overwrite; a change of several tables
    is as many, children first, and can be run again after a failure.
    """

    spark: SparkSession
    database: str
    buckets: int = 16

    @classmethod
    def create(cls, spark: SparkSession, database: str, names: Iterable[str] = tuple(S.TABLES), location: str | None = None, buckets: int = 16) -> Store:
        """A database with empty tables of those names; tables that are there stay."""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}" + (f" LOCATION '{location}'" if location else ""))
        for name in names:
            spark.sql(S.ddl(name, database, BUCKET))
        return cls(spark, database, buckets)

    def _name(self, name: str) -> str:
        return f"{self.database}.{name}"

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self._name(name)).drop(BUCKET)

    def tables(self) -> dict[str, DataFrame]:
        """All tables that were created."""
        there = {r.tableName for r in self.spark.sql(f"SHOW TABLES IN {self.database}").collect()}
        return {name: self.table(name) for name in S.TABLES if name in there}

    def get(self, name: str, id: str) -> DataFrame:
        """The row with that primary key, from its partition alone."""
        rows = self.spark.table(self._name(name))
        bucket = self.spark.range(1).select(self._bucket(F.lit(id)).alias("b")).first()["b"]
        return rows.where((F.col(BUCKET) == bucket) & (F.col(key_of(name)) == id)).drop(BUCKET)

    def append(self, name: str, rows: DataFrame, key: list[str] | None = None) -> None:
        """Adds rows by column name. Omitted columns get the table's defaults, and the primary key, where it is omitted, one from the columns `key`, or a random one.

        Rows are looked at first, with their defaults: if one lacks a value, repeats a key or names a parent that is not there,
        Rejected says why and nothing is written.
        """
        id = key_of(name)
        named = stored.staged(_with_key(rows, name, key), f"append-{name}")
        known = [c.name for c in S.columns(name) if c.name in named.columns]
        checked = integrity.with_defaults(named, name)
        bad = integrity.rejections(self.table(name), checked, name, self.tables()).where(F.size("reasons") > 0).select("reasons").limit(1).collect()
        if bad:
            raise Rejected(f"{name}: {'; '.join(bad[0]['reasons'])}")
        new = named.select(*known, self._bucket(F.col(id)).alias(BUCKET)).repartition(BUCKET)
        self.spark.sql(f"INSERT INTO {self._name(name)} BY NAME SELECT * FROM {{rows}}", rows=new)

    def patch(self, name: str, changes: DataFrame) -> None:
        """A partial update: values that are not null replace those of the rows with their primary key. Partitions without such a key stay as they are."""
        key = key_of(name)
        changes = stored.staged(changes.where(F.col(key).isNotNull()), f"patch-{name}")
        self._rewrite(name, changes.select(key), lambda rows: integrity.patch(rows, changes, key))

    def delete(self, name: str, ids: DataFrame) -> dict[str, int]:
        """Deletes rows by primary key with all that cascades take along, and clears references that are set null. Returns the rows gone by table.

        Where a reference with no action would be left without its parent, Rejected says which, and nothing is written.
        """
        tables = self.tables()
        gone = {t: stored.staged(ids, f"gone-{t}") for t, ids in integrity.rows_gone(tables, name, ids).items()}
        _, blocked = integrity.delete(tables, name, gone[name])
        held = [f"{t}.{c}" for (t, c), rows in blocked.items() if not rows.isEmpty()]
        if held:
            raise Rejected(f"{name}: named by {', '.join(sorted(held))}")
        counts = {}
        for child in [t for t in reversed(S.TABLES) if t in tables]:
            key = key_of(child)
            cleared = [(r, gone[r.parent].select(F.col(r.key).alias(r.column))) for r in S.references() if r.child == child and r.rule == "N" and r.parent in gone]
            touched = [tables[child].join(keys, r.column, "left_semi").select(key) for r, keys in cleared]
            if child in gone:
                there = tables[child].join(gone[child], key, "left_semi").select(key)
                counts[child] = there.count()
                touched.append(gone[child])
            if not touched:
                continue

            def changed(rows: DataFrame, child: str = child, cleared: list = cleared, key: str = key) -> DataFrame:
                columns = rows.columns
                if child in gone:
                    rows = rows.join(gone[child], key, "left_anti")
                for r, keys in cleared:
                    rows = rows.join(keys.distinct().withColumn("_gone", F.lit(True)), r.column, "left").withColumn(r.column, F.when(F.col("_gone").isNull(), F.col(r.column))).drop("_gone")
                return rows.select(*columns)

            keys = touched[0]
            for more in touched[1:]:
                keys = keys.unionByName(more)
            self._rewrite(child, keys, changed)
        return {t: n for t, n in counts.items() if n}

    def _rewrite(self, name: str, keys: DataFrame, change) -> None:  # noqa: ANN001
        """Writes the partitions of these keys anew, changed; those that are left without rows are dropped. At most `buckets` numbers come to the driver."""
        touched = sorted(r[0] for r in keys.select(self._bucket(F.col(keys.columns[0])).alias(BUCKET)).distinct().collect())
        table = self.spark.table(self._name(name)).where(F.col(BUCKET).isin(touched)) if touched else None
        if table is None:
            return
        before = {r[0] for r in table.select(BUCKET).distinct().collect()}
        columns = table.columns
        new = stored.staged(change(table.drop(BUCKET)).withColumn(BUCKET, self._bucket(F.col(key_of(name)))).select(*columns), f"rewrite-{name}")
        after = {r[0] for r in new.select(BUCKET).distinct().collect()}
        if after:
            new.repartition(BUCKET).write.mode("overwrite").insertInto(self._name(name))
        for bucket in sorted(before - after):
            self.spark.sql(f"ALTER TABLE {self._name(name)} DROP IF EXISTS PARTITION ({BUCKET} = {bucket})")


def _with_key(rows: DataFrame, name: str, key: list[str] | None) -> DataFrame:
    """rows with a primary key: their own, else one from the columns `key`, which are left out if the table has none of that name, else a random one."""
    from quaestor.functions.text import uid

    id, known = key_of(name), {c.name for c in S.columns(name)}
    made = uid(name, F.concat_ws(":", *key)) if key else F.expr("uuid()")
    own = F.coalesce(F.col(id), made) if id in rows.columns else made
    return rows.select(own.alias(id), *(F.col(c) for c in rows.columns if c in known and c != id))


def register(store: Store, users: DataFrame, role: str = "STUDENT", key: list[str] | None = None) -> None:
    """Adds users and, for each, a role: both are looked at before either is written."""
    new = stored.staged(_with_key(users, "users", key), "register")
    roles = new.select(F.col("user_id"), F.lit(role).alias("role_name"))
    bad = integrity.rejections(store.table("user_roles"), integrity.with_defaults(roles, "user_roles", ["user_id"]), "user_roles").where(F.size("reasons") > 0).limit(1).collect()
    if bad:
        raise Rejected(f"user_roles: {'; '.join(bad[0]['reasons'])}")
    store.append("users", new)
    store.append("user_roles", roles, ["user_id"])


def log_in(store: Store, users: DataFrame) -> None:
    """Sets last_login_at of the users (user_id, at) who are there and active."""
    there = store.table("users").where("is_active").join(users.select("user_id", "at"), "user_id")
    store.patch("users", there.select("user_id", F.col("at").alias("last_login_at"), F.col("at").alias("updated_at")))


def log_out(store: Store, users: DataFrame) -> None:
    """Sets last_logout_at of the users (user_id, at) who are there."""
    there = store.table("users").join(users.select("user_id", "at"), "user_id")
    store.patch("users", there.select("user_id", F.col("at").alias("last_logout_at"), F.col("at").alias("updated_at")))
