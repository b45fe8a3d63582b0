"""A job queue whose files are objects of a bucket, changed by conditional writes only.

Control data: a few files of at most MAX_JOBS jobs, read and written one by one by whoever pushes or
pulls. Every change is a function of a file's state; it is written if the file is still what was
read, else it is tried again on what is there now, after a growing random wait. ``operators.queue``
has the same decisions over snapshots of many queues.

A job is leased for a time and free again after it, so it is delivered at least once. Whoever reads
a file that wants splitting, or whose splitting was left, does the next step of it first. A split has
these steps, and any of them can be taken up by another process once the lock has ended: the original
is locked and names its other half; the other half is created, locked, with the first half of the
jobs; the original gives those up; the other half is set free.

Defined results: a missing file, an unknown job and a duration that is not positive change nothing;
a file whose last job goes is deleted; payloads are passed through as they are.
"""

from __future__ import annotations

import json
import queue as waiting
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from typing import Any

from ..sources.blobs import Bucket, Conflict, backoff, normal_directory
from .queue import ACTIVE, MAX_JOBS, PENDING, PREPARING, RUNNING, SPLIT_SECONDS, SPLITTING

# Pushes that are stored together, and the longest wait for them in seconds.
BATCH, BATCH_SECONDS = 16, 0.02

State = dict[str, Any]
#: What a change gives for a file that is to go.
GONE: State = {}


@dataclass(frozen=True)
class Item:
    """A leased job."""

    file_id: str
    job_id: str
    payload: Any


def new_id() -> str:
    """A random number of 128 bits in hex."""
    return uuid.uuid4().hex


def _time(text: str | None) -> datetime | None:
    if not text:
        return None
    head, dot, rest = text.rstrip("Z").partition(".")
    digits = rest[:6]
    return datetime.fromisoformat(head + (dot + digits if dot else "") + "+00:00")


def _text(at: datetime) -> str:
    return at.astimezone(timezone.utc).isoformat().replace("+00:00", "Z")


def _expired(text: str | None, now: datetime) -> bool:
    at = _time(text)
    return at is not None and at <= now


def read_state(raw: bytes) -> State:
    """A file's state, with the statuses that an empty or missing one stands for."""
    out = json.loads(raw)
    jobs = [job | {"status": job.get("status") or PENDING} for job in out.get("jobs") or []]
    return out | {"status": out.get("status") or ACTIVE, "jobs": jobs}


def _without(state: State, *keys: str) -> State:
    return {k: v for k, v in state.items() if k not in keys}


def _idle(state: State) -> bool:
    return all(job["status"] == PENDING for job in state["jobs"])


class JobQueue:
    """Jobs below a directory of a bucket. ``now`` and ``sleep`` can be replaced in tests."""

    def __init__(self, bucket: Bucket, directory: str = "queue", now: Callable[[], datetime] = lambda: datetime.now(timezone.utc), sleep: Callable[[float], None] | None = None):
        self.bucket, self.directory, self.now = bucket, normal_directory(directory), now
        self.pauses = (lambda: backoff(sleep=sleep)) if sleep else backoff

    # --- files

    def _key(self, file_id: str) -> str:
        return f"{self.directory}/{file_id}.json".lstrip("/")

    def file_ids(self) -> list[str]:
        """Ids of all files, in order."""
        prefix = f"{self.directory}/".lstrip("/")
        return sorted(k.removeprefix(prefix).removesuffix(".json") for k in self.bucket.list(prefix) if k.endswith(".json"))

    def read(self, file_id: str) -> tuple[State, str] | None:
        """State and etag of a file; None if there is none."""
        try:
            raw, etag = self.bucket.get(self._key(file_id))
        except FileNotFoundError:
            return None
        return read_state(raw), etag

    def create(self, file_id: str, state: State) -> bool:
        """Writes a new file; False if it is there already."""
        try:
            self.bucket.put(self._key(file_id), json.dumps(state).encode())
        except Conflict:
            return False
        return True

    def change(self, file_id: str, change: Callable[[State], State | None]) -> State | None:
        """Applies ``change`` to a file until it is stored; None if it or the file gives nothing to do."""
        for _ in self._tries():
            found = self.read(file_id)
            state = change(found[0]) if found else None
            if state is None:
                return None
            try:
                if state is GONE:
                    self.bucket.delete(self._key(file_id), found[1])
                else:
                    self.bucket.put_if_match(self._key(file_id), json.dumps(state).encode(), found[1])
                return state
            except (Conflict, FileNotFoundError):
                continue

    def _tries(self):
        """The first try at once, each further one after a longer wait."""
        yield 0
        yield from self.pauses()

    # --- producing

    def push(self, payloads: list[Any]) -> str | None:
        """Stores pending jobs together, in the file where new jobs go; gives its id."""
        if not payloads:
            return None
        jobs = [{"id": new_id(), "status": PENDING, "payload": p} for p in payloads]
        grown = lambda state: state | {"jobs": state["jobs"] + jobs} | ({"status": PREPARING} if len(state["jobs"]) + len(jobs) > MAX_JOBS else {})
        for _ in self._tries():
            files = self.file_ids()
            if not files:
                file_id = new_id()
                if self.create(file_id, grown({"status": ACTIVE, "jobs": []})):
                    return file_id
                continue
            target = self._place(files)
            if target and self.change(target, lambda s: grown(s) if s["status"] in (ACTIVE, PREPARING) else None):
                return target

    def _place(self, files: list[str]) -> str | None:
        """The first open file with a quarter of MAX_JOBS or more, else the first open one."""
        first = None
        for file_id in files:
            state = self.settled(file_id)
            if state is None or state["status"] not in (ACTIVE, PREPARING):
                continue
            if len(state["jobs"]) >= MAX_JOBS // 4:
                return file_id
            first = first or file_id
        return first

    # --- consuming

    def pull(self, seconds: float, wait: bool = True) -> Item | None:
        """Leases a job; without ``wait`` None if none is free."""
        for _ in self._tries():
            for file_id in self.file_ids():
                if item := self.pull_from(file_id, seconds):
                    return item
            if not wait:
                return None

    def pull_from(self, file_id: str, seconds: float) -> Item | None:
        """Leases the first free job of an active file."""
        taken: list[State] = []

        def lease(state: State) -> State | None:
            now = self.now()
            taken.clear()
            if state["status"] != ACTIVE:
                return None
            for i, job in enumerate(state["jobs"]):
                if job["status"] == PENDING or job["status"] == RUNNING and _expired(job.get("lockedUntil"), now):
                    taken.append(job | {"status": RUNNING, "lockedUntil": _text(now + timedelta(seconds=seconds))})
                    return state | {"jobs": [*state["jobs"][:i], taken[0], *state["jobs"][i + 1 :]]}
            return None

        if self.settled(file_id) and self.change(file_id, lease):
            return Item(file_id, taken[0]["id"], taken[0].get("payload"))
        return None

    def extend(self, item: Item, seconds: float) -> bool:
        """Leases a job anew from now."""
        if seconds <= 0:
            return False
        until = _text(self.now() + timedelta(seconds=seconds))

        def again(state: State) -> State | None:
            if not any(job["id"] == item.job_id for job in state["jobs"]):
                return None
            return state | {"jobs": [job | {"status": RUNNING, "lockedUntil": until} if job["id"] == item.job_id else job for job in state["jobs"]]}

        return self.change(item.file_id, again) is not None

    def remove(self, item: Item) -> bool:
        """Deletes a job that is done, and its file with the last one."""

        def drop(state: State) -> State | None:
            left = [job for job in state["jobs"] if job["id"] != item.job_id]
            if len(left) == len(state["jobs"]):
                return None
            return state | {"jobs": left} if left else GONE

        return self.change(item.file_id, drop) is not None

    # --- splitting

    def settled(self, file_id: str) -> State | None:
        """A file's state after the steps that its splitting wanted."""
        for _ in self._tries():
            found = self.read(file_id)
            if found is None or not self.advance(file_id, found[0]):
                return found[0] if found else None

    def advance(self, file_id: str, state: State) -> bool:
        """Does what a file's state asks of its reader; False if it asks nothing, or nothing could be done."""
        if state["status"] == PREPARING and len(state["jobs"]) >= 2 and _idle(state):
            return self.split(file_id) is not None
        if state["status"] != SPLITTING or not _expired(state.get("lockedUntil"), self.now()):
            return False
        if state.get("splitInto"):
            return self._carry_on(file_id)
        origin = state.get("splitFrom")
        if not origin:
            return False
        other = self.read(origin)
        if other and other[0]["status"] == SPLITTING and other[0].get("splitInto") == file_id:
            return _expired(other[0].get("lockedUntil"), self.now()) and self._carry_on(origin)
        return self._free(file_id, "splitFrom")

    def split(self, file_id: str) -> str | None:
        """Splits a file that is to be split and has pending jobs only; gives the new file's id, None if nothing was split."""
        into = new_id()

        def lock(state: State) -> State | None:
            if state["status"] != PREPARING or len(state["jobs"]) < 2 or not _idle(state):
                return None
            return state | {"status": SPLITTING, "splitInto": into, "lockedUntil": self._lock_end()}

        return into if self.change(file_id, lock) is not None and self._carry_on(file_id, fresh=True) else None

    def _lock_end(self) -> str:
        return _text(self.now() + timedelta(seconds=SPLIT_SECONDS))

    def must_extend(self, state: State) -> bool:
        """Whether a split's lock has passed half of its time."""
        at = _time(state.get("lockedUntil"))
        return at is not None and at - self.now() <= timedelta(seconds=SPLIT_SECONDS / 2)

    def _carry_on(self, file_id: str, fresh: bool = False) -> bool:
        """The steps after the original was locked; ``fresh``: by who locked it, else its lock must have ended."""

        def relock(state: State) -> State | None:
            if state["status"] != SPLITTING or not state.get("splitInto"):
                return None
            if not fresh and not _expired(state.get("lockedUntil"), self.now()):
                return None
            return state | {"lockedUntil": self._lock_end()} if not fresh or self.must_extend(state) else state

        state = self.change(file_id, relock)
        if state is None:
            return False
        into, half = state["splitInto"], len(state["jobs"]) // 2
        moved = [job["id"] for job in state["jobs"][:half]]
        if moved and self.read(into) is None:
            self.create(into, {"status": SPLITTING, "splitFrom": file_id, "lockedUntil": state["lockedUntil"], "jobs": state["jobs"][:half]})

        def give_up(now: State) -> State | None:
            if now["status"] != SPLITTING or now.get("splitInto") != into:
                return None
            return _without(now, "splitInto", "lockedUntil") | {"status": ACTIVE, "jobs": [job for job in now["jobs"] if job["id"] not in moved]}

        return self.change(file_id, give_up) is not None and (not moved or self._free(into, "splitFrom"))

    def _free(self, file_id: str, link: str) -> bool:
        """A file is active again and forgets its lock and its other half."""
        return self.change(file_id, lambda s: _without(s, link, "lockedUntil") | {"status": ACTIVE} if s["status"] == SPLITTING else None) is not None


class Producer:
    """Collects pushes for a moment and stores them together; a push returns when its job is stored."""

    def __init__(self, jobs: JobQueue):
        self.jobs, self.asked = jobs, waiting.Queue()
        self.worker = threading.Thread(target=self._run, daemon=True)
        self.worker.start()

    def push(self, payload: Any) -> None:
        done: waiting.Queue = waiting.Queue()
        self.asked.put((payload, done))
        if error := done.get():
            raise error

    def _run(self) -> None:
        while (first := self.asked.get()) is not None:
            batch = [first]
            end = datetime.now() + timedelta(seconds=BATCH_SECONDS)
            last = False
            while len(batch) < BATCH and (left := (end - datetime.now()).total_seconds()) > 0:
                try:
                    more = self.asked.get(timeout=left)
                except waiting.Empty:
                    break
                if more is None:
                    last = True
                    break
                batch.append(more)
            error = None
            try:
                self.jobs.push([payload for payload, _ in batch])
            except Exception as e:
                error = e
            for _, done in batch:
                done.put(error)
            if last:
                return

    def close(self) -> None:
        """Stores what is waiting and ends."""
        self.asked.put(None)
        self.worker.join()
