"""What a run leaves behind: no secret in plans and event logs, one line per decision in the log."""

import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hushframe import sinks
from hushframe.functions.hashing import key_pads, keyed_sha1, write_key
from hushframe.operators import encode
from hushframe.plans import actions
from hushframe.session import settle

KEY = "a secret of one's own"


def test_a_key_file_gives_the_same_hashes_and_codes(spark, tmp_path):
    key = write_key(spark, KEY, f"file://{tmp_path}/keys/k1")
    df = spark.createDataFrame([(i, f"v{i % 40}", None if i % 3 else "w") for i in range(300)], "id int, v string, w string")
    both = df.select(keyed_sha1(F.col("v"), KEY).alias("a"), keyed_sha1(F.col("v"), key).alias("b"), keyed_sha1(F.col("w"), key).alias("c"))
    assert all(r.a == r.b and (r.c is None or len(r.c) == 40) for r in both.collect())
    maps = [settle(encode.code_map(df, ["v", "w"], k)) for k in (KEY, key)]
    rows = [sorted(map(str, encode.encode(df, ["v", "w"], m, secret_key=k, broadcast=b).collect())) for m, k, b in zip(maps, (KEY, key), (True, False))]
    assert rows[0] == rows[1]
    done = actions.deidentify(df, {"v": "Encode", "w": "Drop"}, maps[1], secret_key=key)
    assert sorted(r.v for r in done.collect()) == sorted(r.v for r in actions.deidentify(df, {"v": "Encode", "w": "Drop"}, maps[0], secret_key=KEY).collect())
    with pytest.raises(Exception, match="exist"):
        write_key(spark, "other", f"file://{tmp_path}/keys/k1")


def test_plans_and_event_logs_hold_no_pads(tmp_path):
    """In a session of its own, as the event log is set at its start."""
    script = f"""
        from pyspark.sql import SparkSession, functions as F
        from hushframe.functions.hashing import keyed_sha1, write_key
        from hushframe.operators import encode
        spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
                 .config("spark.eventLog.dir", "file://{tmp_path}/events").config("spark.eventLog.compress", "false")
                 .config("spark.checkpoint.dir", "file://{tmp_path}/shared").config("spark.sql.maxMetadataStringLength", "100000").getOrCreate())
        key = write_key(spark, {KEY!r}, "file://{tmp_path}/key")
        df = spark.range(50).selectExpr("id", "concat('v', id) as v", "id % 7 as w")
        hashed = df.select(keyed_sha1(F.col("v"), key).alias("h"))
        hashed.write.format("noop").mode("overwrite").save()
        hashed.explain("extended")
        codes = encode.code_map(df, ["v", "w"], key)
        coded = encode.encode(df, ["v", "w"], codes, secret_key=key, broadcast=False)
        coded.write.format("noop").mode("overwrite").save()
        coded.explain("formatted")
        spark.stop()
    """
    (tmp_path / "events").mkdir()
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    logged = done.stdout + "".join(p.read_text() for p in (tmp_path / "events").rglob("*") if p.is_file() and not p.name.endswith(".crc"))
    assert len(logged) > 100_000 and "scalar-subquery" in logged
    for pad in key_pads(KEY):
        spellings = [pad.hex(), pad.hex().upper(), pad[:20].decode("latin-1"), " ".join(f"{b:02X}" for b in pad[:8]), ", ".join(map(str, pad[:8]))]
        assert not [x for x in spellings if x in logged]
    assert KEY not in logged


def test_a_retried_run_logs_its_lines_once(spark, tmp_path):
    findings = spark.createDataFrame([("a", "text", "r"), ("b", "text", "r"), ("a", "text", "r")], "table_name string, column_name string, reason string")
    path, said = str(tmp_path / "log"), ["a: Dropped columns: text"]
    sinks.append_log(findings.limit(1), path, run_id="run-1")  # the first try got this far
    for _ in range(2):
        sinks.append_log(findings, path, said, run_id="run-1")
    sinks.append_log(findings, path, said, run_id="run-2")
    sinks.append_log(findings, path)
    lines = sorted(tuple(r) for r in sinks.read_log(spark, path).where("run like 'run-%'").collect())
    line = "{}: Column 'text' considered possible pii: r"
    one = [line.format("a"), line.format("a"), line.format("b"), said[0]]
    assert lines == [(run, x) for run in ("run-1", "run-2") for x in sorted(one)]
    assert sinks.read_log(spark, path).where("run not like 'run-%'").count() == 3
    with pytest.raises(ValueError, match="run id"):
        sinks.append_log(findings, path, run_id="../x")
