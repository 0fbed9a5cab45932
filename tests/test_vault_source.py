"""Files of a vault through Spark's data source API, with a handler that a test adds."""

import os
import zipfile

import pytest

from vaultspark.sources.vault_source import Quarantine, VaultFiles

WORDS = "enough words to be a body of a note, as they are found in any vault"


@pytest.fixture
def folder(tmp_path):
    f = tmp_path / "in"
    (f / "sub").mkdir(parents=True)
    (f / "a.md").write_text(f"# A\n\n{WORDS}")
    (f / "sub" / "b.txt").write_text(WORDS)
    (f / "c.ini").write_text("[s]\nk = " + WORDS)
    (f / "d.bin").write_bytes(b"\0\1")
    (f / ".hidden.md").write_text(WORDS)
    with zipfile.ZipFile(f / "z.zip", "w") as z:
        z.writestr("one.txt", WORDS)
        z.writestr("two.ini", "broken")
    return str(f)


def ini_handler():
    def ini(raw: bytes):
        text = raw.decode()
        if not text.startswith("["):
            raise Quarantine("no section")
        return text[1 : text.index("]")], text.split("=", 1)[1].strip(), {"kind": "ini"}

    return ini  # a function within one travels whole; workers don't know this module


def told(df):
    return {os.path.basename(r.member): (r.status, r.handler) for r in df.collect()}


def test_batch_read_with_and_without_a_new_handler(spark, folder):
    spark.dataSource.register(VaultFiles)
    rows = told(spark.read.format("vault_files").option("path", folder).load())
    assert rows["a.md"] == rows["b.txt"] == ("processed", "text") and rows["c.ini"][0] == rows["d.bin"][0] == "quarantined" and ".hidden.md" not in rows
    spark.dataSource.register(VaultFiles.of({"ini": ("ini", ini_handler())}))
    df = spark.read.format("vault_files").option("path", f"file://{folder}").load()
    rows = told(df)
    assert rows["c.ini"] == ("processed", "ini") and [r.reason for r in df.filter("member LIKE '%two.ini'").collect()] == ["no section"]
    assert df.filter("handler = 'ini' AND status = 'processed'").select("title", "body").collect() == [("s", WORDS)]


def test_sql_view_and_options(spark, folder):
    spark.dataSource.register(VaultFiles)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW arrivals USING vault_files OPTIONS (path '{folder}', glob '*.md', maxFileBytes '10')")
    assert [(r.status, "larger than 10 bytes" in r.reason) for r in spark.sql("SELECT status, reason FROM arrivals").collect()] == [("quarantined", True)]
    many = spark.read.format("vault_files").option("path", folder).option("partitionBytes", "1").load()
    assert many.rdd.getNumPartitions() == 5 and many.count() == 6
    with pytest.raises(Exception, match="path"):
        spark.read.format("vault_files").load().count()


def test_stream_sees_each_file_once(spark, folder, tmp_path):
    spark.dataSource.register(VaultFiles)
    for i, name in enumerate(sorted(os.listdir(folder))):
        os.utime(f"{folder}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))

    def drain():
        s = spark.readStream.format("vault_files").option("path", folder).load()
        s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(60)
        return sorted(os.path.basename(r.member) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = drain()
    assert first == ["a.md", "b.txt", "c.ini", "d.bin", "z.zip!one.txt", "z.zip!two.ini"]
    with open(f"{folder}/late.txt", "w") as f:
        f.write(WORDS)
    again = drain()
    assert again == sorted([*first, "late.txt"])


def test_empty_folder(spark, tmp_path):
    spark.dataSource.register(VaultFiles)
    (tmp_path / "none").mkdir()
    assert spark.read.format("vault_files").option("path", str(tmp_path / "none")).load().count() == 0
