"""Sinks that may be tried again."""

import pytest

from vaultsieve.operators import models
from vaultsieve.sources import versions


def test_a_batch_that_comes_again_writes_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    write = versions.batch_writer(folder, ("id", "token"))
    rows = spark.range(5).selectExpr("id", "concat('t', id) as token", "1 as extra")
    assert versions.read_batches(spark, folder, "id long, token string").count() == 0
    write(rows, 0)
    write(rows, 0)
    write(rows.where("id > 2"), 1)
    write(rows.where("false"), 2)
    found = versions.read_batches(spark, folder, "id long, token string")
    assert versions.committed(spark, folder) == [0, 1, 2]
    assert sorted((r.batch, r.id, r.token) for r in found.collect()) == [(0, i, f"t{i}") for i in range(5)] + [(1, i, f"t{i}") for i in (3, 4)]
    # One that broke off before its number was written isn't read, and is written over.
    rows.write.json(f"{folder}/batches/3")
    assert versions.read_batches(spark, folder, "id long, token string").count() == 7
    write(rows.where("id = 0"), 3)
    assert versions.read_batches(spark, folder, "id long, token string").count() == 8


def test_a_stream_that_starts_anew_writes_each_row_once(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.json").write_text('{"id": 1}\n{"id": 2}\n')

    def run(checkpoint: str):
        stream = spark.readStream.schema("id long").json(str(source)).writeStream.foreachBatch(versions.batch_writer(folder))
        stream.option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination(60)

    run("one")
    (source / "b.json").write_text('{"id": 3}\n')
    run("one")
    assert sorted(r.id for r in versions.read_batches(spark, folder, "id long").collect()) == [1, 2, 3]
    run("two")  # its checkpoint is lost: the batches' numbers come again
    assert sorted(r.id for r in versions.read_batches(spark, folder, "id long").collect()) == [1, 2, 3]


def test_versions_of_models(spark, tmp_path):
    root = str(tmp_path / "models")
    rows = spark.range(60).selectExpr("id", "cast(id % 2 as int) as label", "cast(id % 2 as double) + id / 1000 as a")
    model = models.trees(["a"], rounds=2, depth=2).fit(rows)
    with pytest.raises(FileNotFoundError):
        versions.load_version(spark, root)
    folder = versions.save_version(spark, root, "v1", {"scorer": model}, {"threshold": 0.4, "platt": [-10.0, 5.0]})
    versions.save_version(spark, root, "v2", {"scorer": model, "other": model}, {"threshold": 0.5})
    with pytest.raises(FileExistsError):
        versions.save_version(spark, root, "v1", {"scorer": model}, {})
    assert versions.versions(spark, root) == ["v1", "v2"]
    found, config = versions.load_version(spark, root, "v1")
    assert config == {"version": "v1", "models": ["scorer"], "threshold": 0.4, "platt": [-10.0, 5.0]}
    same = models.scored(found["scorer"], rows).join(models.scored(model, rows, "want"), "id")
    assert same.where("score != want").count() == 0
    # A half-written version is never read.
    model.write().save(f"{root}/v3/models/scorer")
    assert versions.load_version(spark, root)[1]["version"] == "v2"
    with pytest.raises(FileNotFoundError):
        versions.load_version(spark, root, "v3")
    # Nor one whose files are not as they were written.
    (tmp_path / "models" / "v1" / "config" / "more.txt").write_text("{}")
    with pytest.raises(ValueError, match="not as written"):
        versions.load_version(spark, root, "v1")
    assert folder == f"{root}/v1"
