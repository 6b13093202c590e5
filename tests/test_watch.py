"""Watching with state: bursts of changes give one scan, changes during a scan give one more."""

import json
import time

from rulegrain.streaming.watch import watch


def test_bursts(spark, tmp_path):
    (tmp_path / "events").mkdir()
    scans, slow = [], {"seconds": 0.0}

    def write(name, rows):
        draft = tmp_path / f".{name}"
        draft.write_text("\n".join(json.dumps({"repo_id": r, "path": p}) for r, p in rows))
        draft.rename(tmp_path / "events" / f"{name}.json")

    def scan(repos):
        scans.append(sorted(r["repo_id"] for r in repos.collect()))
        time.sleep(slow["seconds"])

    def until(n, seconds=60):
        end = time.monotonic() + seconds
        while len(scans) < n and time.monotonic() < end:
            time.sleep(0.1)
        return len(scans)

    events = spark.readStream.schema("repo_id string, path string").option("maxFilesPerTrigger", 100).json(str(tmp_path / "events"))
    roots = spark.createDataFrame([("a", "/a"), ("b", "/b")], "repo_id string, root string")
    query = watch(events, roots, scan, str(tmp_path / "checkpoint"))
    try:
        write("own", [("a", ".rulegrain/last.json"), ("a", "rulegrain-fixes.md"), ("unknown", "x")])
        write("burst", [("a", f"src/f{i}.ts") for i in range(100)])
        assert until(1) == 1 and scans[0] == ["a"]
        time.sleep(3)
        assert len(scans) == 1  # one for all hundred
        slow["seconds"] = 4.0
        write("second", [("b", "AGENTS.md")])
        assert until(2) == 2 and scans[1] == ["b"]
        for i in range(3):  # while the scan runs
            write(f"during{i}", [("b", f"f{i}"), ("b", "AGENTS.md")])
            time.sleep(0.3)
        slow["seconds"] = 0.0
        assert until(3) == 3 and scans[2] == ["b"]
        time.sleep(3)
        assert len(scans) == 3 and query.isActive
    finally:
        query.stop()
