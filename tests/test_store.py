"""Written tables: defaults, rejected lots, and changes that touch only their partitions."""

from __future__ import annotations

import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quaestor.operators import store as ST

USERS = "user_id string, full_name string, email string, password_hash string"


@pytest.fixture
def made(spark, tmp_path):
    names = ("users", "user_roles", "courses", "course_workspaces", "course_documents", "document_pages", "chapters")
    store = ST.Store.create(spark, f"t_{uuid.uuid4().hex}", names, f"file://{tmp_path}/db", buckets=8)
    store.append("users", spark.createDataFrame([(f"u{i}", f"n{i}", f"m{i}@x", "h") for i in range(40)], USERS))
    return store, tmp_path / "db"


def files(folder: Path, table: str) -> set[str]:
    return {str(p) for p in (folder / table).rglob("*.parquet")}


def parts(names: set[str]) -> set[str]:
    return {n.rsplit("/", 2)[1] for n in names}


def test_defaults_of_omitted_columns(made):
    rows = made[0].table("users").collect()
    assert len(rows) == 40 and all(r.is_active and r.created_at and r.updated_at and r.last_login_at is None for r in rows)


def test_keys_are_made(spark, made):
    store, _ = made
    new = spark.createDataFrame([("c1", "One"), ("c2", "Two")], "course_code string, course_name string")
    store.append("courses", new, ["course_code"])
    ids = {r.course_code: r.course_id for r in store.table("courses").collect()}
    with pytest.raises(ST.Rejected, match="course_id not unique"):
        store.append("courses", new, ["course_code"])
    store.append("courses", new.withColumn("course_code", F.concat("course_code", F.lit("x"))))
    assert store.table("courses").count() == 4 and len(set(ids.values())) == 2


def test_a_rejected_lot_changes_nothing(spark, made):
    store, folder = made
    before = files(folder, "users")
    lots = [[("u1", "n", "new@x", "h")], [("v1", "n", "m1@x", "h")], [("v1", None, "v@x", "h")], [("v1", "n", "v@x", "h"), ("v1", "n", "w@x", "h")]]
    for lot, why in zip(lots, ("user_id not unique", "email not unique", "full_name missing", "user_id not unique"), strict=True):
        with pytest.raises(ST.Rejected, match=why):
            store.append("users", spark.createDataFrame([("ok", "n", "ok@x", "h"), *lot], USERS))
    with pytest.raises(ST.Rejected, match="user_id not among users"):
        store.append("user_roles", spark.createDataFrame([("nobody", "ADMIN")], "user_id string, role_name string"))
    assert files(folder, "users") == before and store.table("users").count() == 40
    store.append("users", spark.createDataFrame([], USERS))
    assert store.table("users").count() == 40


def test_registering_writes_both_or_none(spark, made):
    store, folder = made
    new = spark.createDataFrame([("Ann", "ann@x", "h")], "full_name string, email string, password_hash string")
    before = files(folder, "users")
    with pytest.raises(ST.Rejected, match="role_name not allowed"):
        ST.register(store, new, "KING", ["email"])
    assert files(folder, "users") == before
    ST.register(store, new, "TEACHER", ["email"])
    assert [tuple(r) for r in store.table("users").join(store.table("user_roles"), "user_id").select("email", "role_name").collect()] == [("ann@x", "TEACHER")]


def test_login_rewrites_its_partition_only(spark, made):
    store, folder = made
    store.patch("users", spark.createDataFrame([("u7", False)], "user_id string, is_active boolean"))
    before = files(folder, "users")
    at = F.lit("2024-02-02").cast("timestamp_ntz").alias("at")
    ST.log_in(store, spark.createDataFrame([("u3",), ("u7",), ("nobody",), (None,)], "user_id string").select("user_id", at))
    after = files(folder, "users")
    assert parts(before - after) == parts(after - before) and len(parts(after - before)) == 1
    changed = store.table("users").where("last_login_at IS NOT NULL").collect()
    assert [r.user_id for r in changed] == ["u3"] and changed[0].full_name == "n3" and store.table("users").count() == 40
    ST.log_out(store, spark.createDataFrame([("u7",)], "user_id string").select("user_id", at))
    assert store.get("users", "u7").collect()[0].last_logout_at is not None and store.get("users", "none").isEmpty()


def test_cascades_set_null_and_blocks(spark, made):
    store, folder = made
    make = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    store.append("courses", make([("c1", "c1", "C", "u1"), ("c2", "c2", "C", "u2")], "course_id course_code course_name created_by"))
    store.append("chapters", make([("h1", "c2", "H")], "chapter_id course_id chapter_title"))
    store.append("course_workspaces", make([("w1", "c1", "W", "u1"), ("w2", "c2", "W", None)], "workspace_id course_id workspace_title owner_user_id"))
    doc = "document_id workspace_id course_id chapter_id document_title original_filename file_type file_path uploaded_by"
    store.append("course_documents", make([(f"d{i}", f"w{i % 2 + 1}", f"c{i % 2 + 1}", "h1" if i == 1 else None, "t", "f", "TXT", "/f", "u1") for i in range(10)], doc))
    store.append("document_pages", spark.range(30).select(F.concat(F.lit("d"), F.col("id") % 10).alias("document_id"), F.col("id").cast("int").alias("page_number")), ["document_id", "page_number"])
    with pytest.raises(ST.Rejected, match="course_documents.chapter_id"):
        store.delete("chapters", make([("h1",)], "chapter_id"))
    assert store.table("chapters").count() == 1
    users = files(folder, "users")
    assert store.delete("course_workspaces", make([("w1",)], "workspace_id")) == {"course_workspaces": 1, "course_documents": 5, "document_pages": 15}
    assert {r.document_id for r in store.table("document_pages").collect()} == {f"d{i}" for i in range(1, 10, 2)}
    assert files(folder, "users") == users  # nothing of theirs was touched
    assert store.delete("users", make([("u1",)], "user_id")) == {"users": 1}
    assert {r.uploaded_by for r in store.table("course_documents").collect()} == {None} and store.table("course_documents").count() == 5
    assert [(r.course_id, r.created_by) for r in store.table("courses").orderBy("course_id").collect()] == [("c1", None), ("c2", "u2")]
    assert store.delete("course_workspaces", make([("w2",)], "workspace_id"))["document_pages"] == 15
    assert store.table("document_pages").isEmpty() and not files(folder, "document_pages")


def test_create_twice_keeps_rows(spark, made):
    store, _ = made
    again = ST.Store.create(spark, store.database, ("users",), buckets=8)
    assert again.table("users").count() == 40 and set(again.tables()) == set(store.tables())
