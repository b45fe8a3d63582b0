"""The job queue on a bucket: life of jobs, splitting and its recovery, and writers at the same time."""

import json
import threading
from datetime import datetime, timedelta, timezone

import pytest

from logweir.operators import jobqueue
from logweir.plans import control
from logweir.sources import blobs


@pytest.fixture
def clock():
    class Clock:
        at = datetime(2025, 1, 1, tzinfo=timezone.utc)

        def __call__(self):
            return self.at

    return Clock()


@pytest.fixture
def jobs(tmp_path, clock):
    return jobqueue.JobQueue(blobs.Bucket(f"file://{tmp_path}/bucket"), " /queue/ ", clock, lambda s: None)


def everything(jobs):
    return sorted(job["payload"] for f in jobs.file_ids() for job in jobs.read(f)[0]["jobs"])


def test_life_of_a_job(jobs, clock):
    assert jobs.pull(10, wait=False) is None and jobs.push([]) is None
    file_id = jobs.push([1, 2])
    item = jobs.pull(10)
    assert (item.file_id, item.payload) == (file_id, 1) and jobs.pull(10).payload == 2 and jobs.pull(10, wait=False) is None
    clock.at += timedelta(seconds=5)
    assert jobs.extend(item, 10) and not jobs.extend(item, 0) and not jobs.extend(jobqueue.Item(file_id, "none", None), 5)
    clock.at += timedelta(seconds=5)
    # the lease of the second one ends at its very time, the first was extended
    assert jobs.pull(10).payload == 2 and jobs.pull(10, wait=False) is None
    assert jobs.remove(item) and not jobs.remove(item) and everything(jobs) == [2]
    clock.at += timedelta(seconds=10)
    assert jobs.remove(jobs.pull(1)) and jobs.file_ids() == [] and not jobs.remove(item) and not jobs.extend(item, 1)


def test_large_files_are_split_once_their_jobs_are_pending(jobs, clock):
    file_id = jobs.push(list(range(128)))
    assert jobs.read(file_id)[0]["status"] == "active"
    jobs.push([128])
    assert jobs.read(file_id)[0]["status"] == "preparing_split"
    jobs.push([129])
    assert len(jobs.file_ids()) == 2 and everything(jobs) == list(range(130))
    states = [jobs.read(f)[0] for f in jobs.file_ids()]
    assert all(s["status"] == "active" and not {"splitInto", "splitFrom", "lockedUntil"} & set(s) for s in states)
    assert [j["payload"] for j in jobs.read(next(f for f in jobs.file_ids() if f != file_id))[0]["jobs"]][:64] == list(range(64))


def test_a_split_gives_the_id_of_the_new_file(jobs):
    file_id = jobs.push(list(range(129)))
    into = jobs.split(file_id)
    assert jobs.file_ids() == sorted([file_id, into]) and jobs.split(file_id) is None


def test_splitting_files_does_not_list_the_bucket_for_each(spark, tmp_path, monkeypatch):
    job = lambda n, i: {"id": f"j{n}-{i}", "status": "in_progress" if (n, i) == (5, 0) else "pending"}
    files = [(f"queue/f{n}.json", json.dumps({"status": "active", "jobs": [job(n, i) for i in range(3)]})) for n in range(6)]
    spark.createDataFrame(files, "obj_key string, raw string").write.parquet(f"{tmp_path}/blob_objects.parquet")
    listings, listed = [], blobs.Bucket.list
    monkeypatch.setattr(blobs.Bucket, "list", lambda self, prefix="": listings.append(prefix) or listed(self, prefix))
    found = control.queue_split_stored(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(f"f{n}", f"j{n}-{i}", i == 0) for n in range(5) for i in range(3)]
    # once before the changes and once to go through the files, whatever their number
    assert len(listings) == 2


def test_a_file_in_use_is_not_split(jobs):
    file_id = jobs.push(list(range(128)))
    jobs.pull(10)
    jobs.push([128])
    assert jobs.file_ids() == [file_id] and jobs.pull(10, wait=False) is None


@pytest.mark.parametrize("stop", ["locked", "created", "given up"])
def test_a_split_that_was_left_is_taken_up_after_its_lock(jobs, clock, stop, monkeypatch):
    file_id = jobs.push(list(range(129)))
    change, create = jobs.change, jobs.create

    class Left(Exception):
        pass

    def stopped(*_):
        raise Left

    if stop == "locked":
        monkeypatch.setattr(jobs, "create", stopped)
    else:
        calls = iter(range(9))
        monkeypatch.setattr(jobs, "change", lambda f, c: stopped() if next(calls) == (2 if stop == "created" else 3) else change(f, c))
    with pytest.raises(Left):
        jobs.split(file_id)
    monkeypatch.setattr(jobs, "change", change)
    monkeypatch.setattr(jobs, "create", create)
    locked = [f for f in jobs.file_ids() if jobs.read(f)[0]["status"] == "splitting"]
    assert locked and not any(jobs.advance(f, jobs.read(f)[0]) for f in locked)
    clock.at += timedelta(seconds=30)
    assert jobs.pull(1) is not None
    jobs.pull(1), [jobs.settled(f) for f in jobs.file_ids()]
    assert len(jobs.file_ids()) == 2 and everything(jobs) == list(range(129))
    assert all(jobs.read(f)[0]["status"] == "active" for f in jobs.file_ids())


def test_two_writers_lose_no_job(tmp_path):
    queues = [jobqueue.JobQueue(blobs.Bucket(f"file://{tmp_path}/bucket")) for _ in range(4)]
    producers = [jobqueue.Producer(q) for q in queues[:2]]
    seen, lock = [], threading.Lock()

    def produce(k):
        for i in range(60):
            producers[k % 2].push(k * 1000 + i)

    def consume(q):
        while len(seen) < 240:
            if item := q.pull(30, wait=False):
                q.remove(item)
                with lock:
                    seen.append(item.payload)

    threads = [threading.Thread(target=produce, args=(k,)) for k in range(4)] + [threading.Thread(target=consume, args=(q,), daemon=True) for q in queues[2:]]
    [t.start() for t in threads]
    [t.join(60) for t in threads]
    [p.close() for p in producers]
    assert sorted(seen) == sorted(k * 1000 + i for k in range(4) for i in range(60)) and queues[0].file_ids() == []


def test_of_two_conditional_writes_one_wins(tmp_path):
    bucket = blobs.Bucket(f"file://{tmp_path}/b")
    for turn in range(20):
        tag, won = bucket.put("k", b"%d" % turn, replace=True), []

        def write(n, tag=tag, won=won):
            try:
                blobs.Bucket(f"file://{tmp_path}/b").put_if_match("k", b"w%d" % n, tag)
                won.append(n)
            except blobs.Conflict:
                pass

        threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert len(won) == 1 and bucket.get("k")[0] == b"w%d" % won[0]


def test_a_lock_that_was_left_ends(tmp_path, monkeypatch):
    bucket = blobs.Bucket(f"file://{tmp_path}/b")
    bucket.put("k", b"1")
    (tmp_path / "b" / "k.lock").touch()
    with pytest.raises(blobs.Conflict):
        bucket.put("k", b"2", replace=True)
    monkeypatch.setattr(blobs.Bucket, "LOCK_SECONDS", -1.0)
    bucket.put("k", b"2", replace=True)
    assert bucket.get("k")[0] == b"2" and bucket.list() == ["k"]


def test_off_a_local_disk_conditional_writes_need_a_session(spark, tmp_path):
    bucket = blobs.Bucket(f"file://{tmp_path}/b", spark)
    bucket.system = type("Elsewhere", (), {"__getattr__": lambda self, name, s=bucket.system: getattr(s, name)})()
    tag = bucket.put("k", b"1")
    assert bucket.put_if_match("k", b"2", tag) and bucket.get("k")[0] == b"2"
    bucket.spark = None
    with pytest.raises(ValueError, match="session"):
        bucket.put("k", b"3", replace=True)


def test_directories_are_normalised():
    assert [blobs.normal_directory(d) for d in ("", "/", " a/b/ ", "//a")] == ["", "", "a/b", "a"]
