"""A plain parser with one hand-written pattern per layout, to test the mined one against."""

import json
import re
from datetime import datetime, timedelta, timezone

N = r"(?P<c>[\w./-]+)"
LV = r"(?P<l>[A-Za-z]+)"
PATTERNS = [
    ("iso", rf"(?P<t>\d{{4}}-\d\d-\d\d [\d:]+,\d+) {LV} +\[[^\]]*\] {N} - "),
    ("iso", rf"(?P<t>\d{{4}}-\d\d-\d\d [\d:]+,\d+) - {N} - {LV} - "),
    ("iso", rf"(?P<t>\d{{4}}-\d\d-\d\d[T ][\d:.]+Z) (?:\x1b\[\d+m)?{LV}(?:\x1b\[0m)? +\[{N}\] "),
    ("rfc", rf"(?P<t>\w+, \d+ \w+ \d{{4}} [\d:]+ GMT) \| {LV} \| {N} \| "),
    ("iso", rf'time="(?P<t>[^"]+)" lvl={LV} logger="{N}" msg='),
    ("iso", rf"ts=(?P<t>\S+) level={LV} component={N} msg="),
    ("iso", rf'level={LV} ts=(?P<t>\S+) msg=.* component={N} pid=\d+$'),
    ("go", rf"(?P<t>\d{{4}}/\d\d/\d\d [\d:]+\.\d+) {N}:\d+: "),
    ("go", r"(?P<t>\d{4}/\d\d/\d\d [\d:]+) \[(?P<l>[a-z]+)\] \d+#\d+: "),
    ("apache", rf"\[(?P<t>\d\d/\w+/\d{{4}}:[\d:]+ [+-]\d{{4}})\] \((?P<l>..)\) {N}: "),
    ("iso", rf"<(?P<p>\d+)>1 (?P<t>\S+) \S+ {N} \d+ \S+ - "),
    ("syslog", rf"(?:<(?P<p>\d+)>)?(?P<t>[A-Z][a-z][a-z] [ \d]\d \d\d:\d\d:\d\d) \S+ (?P<c>[\w.-]+)\[\d+\]: "),
    ("glog", rf"(?P<l>[A-Z])(?P<t>\d{{4}} [\d:.]+) +\d+ {N}:\d+\] "),
    ("compact", rf"(?P<t>\d{{8}}-\d{{6}}\.\d+)\|{LV}\|{N}\|\d+\|"),
    ("clock", rf"(?P<t>\d\d:\d\d:\d\d\.\d+) {LV}/{N}\( *\d+\): "),
    ("ms", rf"(?P<t>\d{{13}}) {LV} <{N}> "),
    ("sec", rf"(?P<t>\d{{10}}\.\d+) {LV} {N}: "),
]
RANK = {"t": "TRACE", "v": "TRACE", "d": "DEBUG", "i": "INFO", "n": "INFO", "w": "WARN", "e": "ERROR", "f": "FATAL", "c": "FATAL", "a": "FATAL", "p": "FATAL"}


def level(text):
    if text in ("emerg", "EMERG"):
        return "FATAL"
    return RANK[text[0].lower()] if text else ""


def micros(dt):
    dt = dt if dt.tzinfo else dt.replace(tzinfo=timezone.utc)
    return (dt - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def when(kind, t, near):
    if kind == "iso":
        return micros(datetime.fromisoformat(t.replace(",", "."))) // 1000
    if kind == "go":
        return micros(datetime.fromisoformat(t.replace("/", "-"))) // 1000
    if kind == "rfc":
        return micros(datetime.strptime(t, "%a, %d %b %Y %H:%M:%S GMT")) // 1000
    if kind == "apache":
        return micros(datetime.strptime(t, "%d/%b/%Y:%H:%M:%S %z")) // 1000
    if kind == "compact":
        return micros(datetime.strptime(t, "%Y%m%d-%H%M%S.%f")) // 1000
    if kind == "ms":
        return int(t)
    if kind == "sec":
        return int(t.replace(".", "")) // 1000
    base = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=near)
    if kind == "clock":
        h = datetime.strptime(t, "%H:%M:%S.%f")
        options = [base.replace(hour=h.hour, minute=h.minute, second=h.second, microsecond=h.microsecond) + timedelta(days=k) for k in (-1, 0, 1)]
    else:
        shape = "%Y %b %d %H:%M:%S" if kind == "syslog" else "%Y %m%d %H:%M:%S.%f"
        options = [datetime.strptime(f"{base.year + k} {t}", shape).replace(tzinfo=timezone.utc) for k in (-1, 0, 1) if not (t.startswith(("Feb 29", "0229")) and (base.year + k) % 4)]
    return micros(min(options, key=lambda o: abs(o - base))) // 1000


def header(line, near):
    line = line.rstrip("\r")
    if line.startswith('{"'):
        try:
            j = json.loads(line)
        except ValueError:
            return None
        t = j.get("timestamp") or j.get("@t") or j.get("time")
        if t is None:
            return None
        lv = j.get("severity") or j.get("lvl") or j.get("level")
        ms = t if isinstance(t, int) else when("iso", t, near)
        name = {10: "TRACE", 20: "DEBUG", 30: "INFO", 40: "WARN", 50: "ERROR", 60: "FATAL"}.get(lv) or level(lv)
        return ms, name, j.get("logger") or j.get("component") or j.get("name") or ""
    for kind, p in PATTERNS:
        if m := re.match(p, line):
            g = m.groupdict()
            lv = ["FATAL"] * 3 + ["ERROR", "WARN", "INFO", "INFO", "DEBUG"]
            return when(kind, g["t"], near), lv[int(g["p"]) % 8] if g.get("p") else level(g.get("l") or ""), g.get("c") or ""
    return None


def entries(records, results):
    """records: (rec_no, stream_id, d); results: (stream_id, document_id, document)."""
    for no, stream, d in records:
        try:
            j = json.loads(d)
        except (ValueError, TypeError):
            continue
        if isinstance(j, dict) and isinstance(j.get("msg"), str) and (h := header(j["msg"].split("\n")[0], j.get("ts"))):
            yield ("wal_records", stream, no, no, *h)
    now = None
    for stream, ident, document in sorted(set(results)):
        try:
            j = json.loads(document)
        except ValueError:
            continue
        if now and now[1] != stream:
            yield tuple(now)
            now = None
        if h := header(j["msg"], j["ts"]):
            if now:
                yield tuple(now)
            now = ["query_results", stream, ident, ident, *h]
        elif now:
            now[3] = ident
    if now:
        yield tuple(now)
