"""Semi-structured log lines into fields, by token n-gram dictionaries.

1. Every line is brought to a shape: typed tokens (times, levels, dotted or slashed names, words
   with digits) become one character each, everything else stays. Equal shapes are counted before
   anything is shuffled.
2. Bigrams and trigrams of the shapes' tokens are counted over all lines. A token that its
   neighbours predict is constant, else it is variable; shapes with variables masked are templates.
3. The head of a shape is its template before free text: typed tokens, marks, and words that the
   dictionaries tell are constant, up to the first word at which lines branch. It is a program's
   header if it begins with a time, or has a time behind other tokens and holds level and component,
   or if what follows it varies. Its tokens receive roles by type: time, level and component; a plain
   word before the time is the component if no other is.
4. Heads are layouts, which are few; lines are joined with them by their first token, and the longest
   head that a line's shape begins with is its own. Such a line begins an entry, the lines after it
   in the stream belong to it.

Defined results: text that is no JSON, a null, an empty or a non-string message is no line; a
document without time takes the given fallback for what a header's date lacks; very long lines are
read whole; repeated lines of a stream with one id count once; a line before any header belongs
to no entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .skew import PIECE, null_safe, piece_offsets, with_offset

# Placeholders of typed tokens, one character each.
TIME, GTIME, LEVEL, NAME, WORD, HOST, PROGRAM, TEXT = "\ue001", "\ue002", "\ue003", "\ue004", "\ue005", "\ue006", "\ue007", "\ue008"
#: Share of what follows its two neighbours from which a token counts as constant.
CONSTANT = 0.01
#: Share of what stands beside two neighbours from which a plain word belongs to a header, and lines
#: that must have shown the neighbours: evidence for a word, whatever the input's size.
FIXED, SEEN = 0.5, 20
#: Different words that must follow a head that is told by nothing else, whatever the input's size.
VARIED = 3

# Spellings of levels and the level each one means.
LEVELS = {
    "TRACE": ["trace", "verbose", "v", "t", "tt", "10"],
    "DEBUG": ["debug", "dbug", "dbg", "d", "dd", "20"],
    "INFO": ["info", "information", "notice", "i", "ii", "n", "nn", "30"],
    "WARN": ["warn", "warning", "w", "ww", "40"],
    "ERROR": ["error", "err", "eror", "e", "ee", "50"],
    "FATAL": ["fatal", "critical", "crit", "alert", "emergency", "emerg", "panic", "f", "ff", "c", "cc", "60"],
}
# The level of each syslog severity from 0 to 7.
SEVERITIES = ["FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG"]
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"

_TIMES = [
    r"\d{4}[-/]\d\d[-/]\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?",
    r"\d\d/[A-Z][a-z]{2}/\d{4}:\d\d:\d\d:\d\d [+-]\d{4}",
    r"(?:[A-Z][a-z]{2}, )?\d\d? [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d(?: GMT| UTC| [+-]\d{4})?",
    r"\d{8}-\d{6}(?:[.,]\d+)?",
    r"[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d",
    r"(?<![\d:])\d\d:\d\d:\d\d[.,]\d+",
    r"(?<![\w.-])\d{13}(?![\w.])",
    r"(?<![\w.-])\d{10}\.\d{3,9}(?!\w)",
]
_TIME = "(?=[0-9A-Z])(?:" + "|".join(_TIMES) + ")"
_GTIME = r"^[VTDINWEFC]\d{4} \d\d:\d\d:\d\d\.\d+"
_WORDS = "|".join(sorted({w for ws in LEVELS.values() for w in ws if len(w) > 2}, key=len, reverse=True))
# looks at a match's first character before anything else, which is quicker
_LEVEL = (
    rf"(?=[{''.join(sorted({w[0] + w[0].upper() for ws in LEVELS.values() for w in ws}))}])(?:(?<![\w.-])(?i:{_WORDS})(?![\w.-])"
    r"|(?<=\|)[VTDINWEFC](?=\|)|(?<=\s)[VTDINWEFC](?=/)|(?<=\()(?:TT|DD|II|NN|WW|EE|FF|CC)(?=\))"
    r'|(?<="(?:level|lvl|severity)":)[1-6]0(?=[,}]))'
)
# Matches start at a word's start and give nothing back, so that they take linear time on a text
# without blanks; nothing is repeated but single characters and short parts, which needs no stack.
_NAME = r"(?<![\w-])[a-z_][\w-]*+(?:[./][a-z_][\w-]*+)++"
_WORD = r"(?<![\w*#.-])[[\w*#.-]&&[^\d]]*+\d[\w#.-]*+"
_QUOTED = r'"[\s\S]*?(?<!(?<!\\)\\)"'


def without_colour(line: Column) -> Column:
    return F.when(line.contains("\x1b"), F.regexp_replace(line, "\x1b\\[[0-9;]*m", "")).otherwise(line)


def _bare(line: Column) -> Column:
    """A line of keys and values with its texts taken out: what has no space stays, unquoted."""
    structured = line.rlike(r'^(?:\{"|[A-Za-z_]\w*=)')
    timed = F.regexp_replace(line, rf'"({_TIME})"', "$1")
    short = F.regexp_replace(timed, r'(?<=[:=])"([^"\s\\]*)"', "$1")
    return F.when(structured, F.regexp_replace(short, rf"(?<=[:=]){_QUOTED}", TEXT)).otherwise(line)


_FREE = rf"^(?:<{WORD}>)?(?:{WORD} )?\[?(?:{TIME}|{GTIME})"
_KEYED = rf'^(?:\{{"[^{TIME}{TEXT}]*:{TIME}.*\}}$|[A-Za-z_]\w*=[^{TEXT}]*?{TIME}.*$)'
# An element of a shape: a typed token, a word or another character, with the blank behind it.
_LETTER = r"\w\u00c0-\u024f"
_ELEMENT = rf"(?:[{_LETTER}]+|[^{_LETTER}]) ?"
_TYPED = f"[{TIME}-{TEXT}]"


def _keyed(shape: Column) -> Column:
    return shape.rlike(_KEYED) & shape.rlike(r'^(?:\{"|[A-Za-z_])')


def skeleton(shape: Column) -> Column:
    """A line of keys and values with its plain values masked: its keys and typed values; null for others."""
    return F.when(_keyed(shape), F.regexp_replace(shape, rf"(?<=[:=])[^{TIME}-{TEXT} ,}}]+", "*"))


def with_shapes(lines: DataFrame) -> DataFrame:
    """Adds to ``line``: its text without colours and quoted values (``bare``), and its shape."""
    bare = lines.withColumn("line", without_colour(F.when(F.endswith("line", F.lit("\r")), F.expr("left(line, length(line) - 1)")).otherwise(F.col("line")))).withColumn("bare", _bare(F.col("line")))
    x = F.regexp_replace("bare", _GTIME, GTIME)
    x = F.regexp_replace(x, _TIME, TIME)
    x = F.regexp_replace(x, _LEVEL, LEVEL)
    x = F.regexp_replace(x, _NAME, NAME)
    x = F.regexp_replace(x, _WORD, WORD)
    syslog = rf"^((?:<{WORD}>)?(?:{WORD} )?{TIME} )\S+ [^\s\[]+(?=\[{WORD}\]:)|^(<{WORD}>{WORD} {TIME} )\S+ \S+(?= (?:{WORD}|-) )"
    typed = bare.withColumn("shape", x)
    shape = F.col("shape")
    single = typed.withColumn("shape", F.when(F.contains(shape, F.lit("  ")) | F.contains(shape, F.lit("\t")), F.regexp_replace(shape, r"[ \t]+", " ")).otherwise(shape))
    shaped = single.withColumn(
        "shape", F.when(F.col("shape").rlike(syslog), F.regexp_replace("shape", syslog, f"$1$2{HOST} {PROGRAM}")).otherwise(F.col("shape"))
    )
    return shaped


def _begins(head: Column) -> Column:
    """Whether a head begins with its time, or is a line of keys and values."""
    return _keyed(head) | head.rlike(_FREE)


def with_fields(shaped: DataFrame) -> DataFrame:
    """Texts of the roles: the first time, level and name; for syslog the program and priority."""
    has = lambda c: F.col("head").contains(c)
    pick = lambda when, pattern, group=0: F.when(when, F.regexp_extract("bare", pattern, group))
    stamp = pick(has(GTIME), _GTIME).otherwise(pick(has(TIME), _TIME))
    program = pick(has(PROGRAM), rf"{_TIME} \S+ ([^\s\[]+)", 1)
    # a word before the time, by the head's own word, since the line may hold others
    led = F.when(~_begins(F.col("head")), F.nullif(F.regexp_extract("head", r"[A-Za-z_][\w-]*", 0), F.lit("")))
    return shaped.withColumns(
        {
            "time_text": stamp,
            "level_text": F.when(has(GTIME), F.substring("bare", 1, 1)).when(F.col("head").startswith("<"), F.regexp_extract("bare", r"^<(\d+)>", 1)).otherwise(pick(has(LEVEL), _LEVEL)),
            "name_text": F.coalesce(program, pick(has(NAME), _NAME), led),
        }
    )


def tokens(shape: Column) -> Column:
    """Tokens of a shape between a start and an end mark: words, and each other mark by itself."""
    return F.concat(F.array(F.lit("^")), F.filter(F.split(F.regexp_replace(shape, r"([^\w\u00c0-\u024f])", "\x01$1\x01"), "[\x01 ]+"), lambda t: t != ""), F.array(F.lit("$")))


def shape_counts(shaped: DataFrame) -> DataFrame:
    return written(shaped.groupBy("shape").agg(F.count(F.lit(1)).alias("n")), "shapes")


def ngrams(shapes: DataFrame, size: int) -> DataFrame:
    """Dictionary of n-grams: (gram, n) over all lines, from the counted shapes."""
    toks = shapes.select("n", tokens(F.col("shape")).alias("t"))
    grams = F.transform(F.sequence(F.lit(1), F.size("t") - size + 1), lambda i: F.array_join(F.slice("t", i, size), " "))
    return toks.where(F.size("t") >= size).select("n", F.explode(grams).alias("gram")).groupBy("gram").agg(F.sum("n").alias("n"))


def dictionaries(shapes: DataFrame) -> DataFrame:
    """(gram, n, n_left, n_right): trigrams, and bigrams as (gram, n) alone.

    ``n_left`` counts a trigram's first two tokens and ``n_right`` its last two, so that shares are
    known without joining shapes by a context that many of them have.
    """
    two, three = ngrams(shapes, 2), ngrams(shapes, 3)
    part = lambda a, n: F.array_join(F.slice(F.split("gram", " "), a, n), " ")
    of = lambda side: two.select(F.col("gram").alias(side), F.col("n").alias(f"n_{side}"))
    full = three.withColumns({"left": part(1, 2), "right": part(2, 2)}).join(of("left"), "left").join(of("right"), "right")
    total = shapes.agg(F.sum("n")).collect()[0][0]
    starts = two.where(F.col("gram").startswith("^ ")).select("gram", "n", F.lit(total).cast("bigint").alias("n_left"), F.lit(None).cast("bigint").alias("n_right"))
    return written(full.select("gram", "n", "n_left", "n_right").unionAll(starts), "grams")


def _spots(shapes: DataFrame) -> DataFrame:
    """Each plain word of each shape with the trigrams that end and begin with it: (shape, i, token, ending, beginning)."""
    t = F.col("t")
    gram = lambda i, n: F.array_join(F.slice(t, i, n), " ")
    each = F.transform(
        F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(t) - 1)),
        lambda i: F.struct((i - 1).alias("i"), F.get(t, i - 1).alias("token"), F.when(i == 2, gram(1, 2)).otherwise(gram(i - 2, 3)).alias("ending"), gram(i, 3).alias("beginning")),
    )
    rows = shapes.withColumn("t", tokens(F.col("shape"))).select("shape", F.explode(each).alias("e")).select("shape", "e.*")
    return rows.where(F.col("token").rlike(rf"^[{_LETTER}]"))


def predicted(shapes: DataFrame, grams: DataFrame) -> DataFrame:
    """Adds to the plain words of shapes how often those before and behind them predict them: (shape, i, before, behind, n_left, n_right)."""
    spots = _spots(shapes)
    ending = grams.select(F.col("gram").alias("ending"), (F.col("n") / F.col("n_left")).alias("before"), "n_left")
    beginning = grams.where("n_right is not null").select(F.col("gram").alias("beginning"), (F.col("n") / F.col("n_right")).alias("behind"), "n_right")
    return spots.join(ending, "ending", "left").join(beginning, "beginning", "left").select("shape", "i", "before", "behind", "n_left", "n_right")


def templates(shapes: DataFrame) -> DataFrame:
    """(shape, n, template): each shape with its variable tokens as ``<*>``.

    A plain word is constant if, of what follows its two predecessors, its share is CONSTANT or
    more, a tenth of that for a first word; typed tokens are variable. The dictionaries are joined
    by key, never collected.
    """
    least = F.when(F.col("i") == 1, CONSTANT / 10).otherwise(CONSTANT)
    free = predicted(shapes, dictionaries(shapes)).where(F.coalesce("before", F.lit(0.0)) < least).groupBy("shape").agg(F.collect_set("i").alias("free"))
    words = F.filter(tokens(F.col("shape")), lambda t: ~t.isin("^", "$"))
    masked = F.transform(words, lambda t, i: F.when(t.rlike(f"^{_TYPED}$") | F.coalesce(F.array_contains("free", i + 1), F.lit(False)), "<*>").otherwise(t))
    return shapes.join(free, "shape", "left").select("shape", "n", F.array_join(masked, " ").alias("template"))


def heads(shapes: DataFrame, grams: DataFrame) -> DataFrame:
    """(shape, n, head): the part of each shape that is its program's header, '' if it has none.

    From the start go typed tokens and marks; plain words before the time that a mark ends, or that
    the tokens on either side predict; plain words behind the time that those before them predict.
    At the first other word lines branch, and the text begins. The head ends with its last typed
    token and the marks behind it. Indented and quoted lines have none. Lines of keys and values
    are heads as a whole, with their plain values masked.
    """
    timed = shapes.where(F.col("shape").contains(TIME) | F.col("shape").contains(GTIME))
    sure = lambda share, n: F.coalesce((F.col(share) >= FIXED) & (F.col(n) >= SEEN), F.lit(False))
    told = predicted(timed.where(~_keyed(F.col("shape"))), grams).select("shape", "i", sure("before", "n_left").alias("after_two"), sure("behind", "n_right").alias("before_two")).where("after_two or before_two")
    known = told.groupBy("shape").agg(F.collect_set(F.when(F.col("after_two"), F.col("i"))).alias("after_two"), F.collect_set("i").alias("either"))
    has = lambda name, i: F.coalesce(F.array_contains(name, i), F.lit(False))
    parts = F.regexp_extract_all("shape", F.lit(f"({_ELEMENT})"), 1)
    state = "struct<open:boolean,timed:boolean,i:int,at:int,end:int>"

    def step(now: Column, e: Column) -> Column:
        token, size = F.rtrim(e["part"]), F.length(e["part"])
        i = now["i"] + (token != "").cast("int")
        typed, word = token.rlike(f"^{_TYPED}$"), token.rlike(rf"^[{_LETTER}]")
        time = token.isin(TIME, GTIME)
        tag = ~now["timed"] & (~e["part"].endswith(" ") & e["next"].rlike(r"^[\]\[:|/)>]"))
        fixed = F.when(now["timed"], has("after_two", i)).otherwise(has("either", i) | tag)
        mark = ~typed & ~word & ~token.isin("\"", "'", "{", "\u00ab")
        goes = now["open"] & (typed | mark | word & fixed)
        end = F.when(goes & (typed | mark & (now["end"] == now["at"])), now["at"] + size).otherwise(now["end"])
        return F.struct(goes.alias("open"), (now["timed"] | goes & time).alias("timed"), i.alias("i"), (now["at"] + size).alias("at"), end.alias("end")).cast(state)

    first = F.struct(F.lit(True), F.lit(False), F.lit(0), F.lit(0), F.lit(0)).cast(state)
    pairs = F.transform(parts, lambda e, k: F.struct(e.alias("part"), F.coalesce(F.get(parts, k + 1), F.lit("")).alias("next")))
    walked = timed.join(known, "shape", "left").withColumn("w", F.aggregate(pairs, first, step))
    found = F.when(F.col("w.timed") & ~F.col("shape").rlike(r"^[\s>]"), F.expr("substring(shape, 1, w.end)")).otherwise("")
    typed = found.rlike(_FREE) | found.contains(LEVEL) | found.contains(NAME) & ~found.rlike("[A-Za-z]")
    return walked.select("shape", "n", F.coalesce(skeleton(F.col("shape")), F.when(typed, found).otherwise("")).alias("head"))


def layouts(headed: DataFrame) -> DataFrame:
    """Heads that are a program's header: by their typed tokens, else by what follows them.

    However rare they are: no head needs a share of the lines.
    """
    head = F.col("head")
    follows = F.nullif(F.regexp_extract(F.expr("substring(shape, length(head) + 1)"), rf"[{_LETTER}]+", 0), F.lit(""))
    found = headed.where("head <> ''").withColumn("follows", follows).groupBy("head").agg(F.sum("n").alias("n_lines"), F.count_distinct("follows").alias("n_follow"))
    typed = head.contains(LEVEL) & head.contains(NAME) & ~head.rlike("[A-Za-z]")
    return found.where(_begins(head) | typed | (F.col("n_follow") >= VARIED))


def mined(shapes: DataFrame) -> DataFrame:
    """The layouts of counted shapes, written: dictionaries, heads, and which heads are headers."""
    return written(layouts(heads(shapes, dictionaries(shapes))), "layouts")


def _lead(shape: Column) -> Column:
    """First element of a shape: what lines and layouts are joined by."""
    return F.regexp_extract(shape, f"^{_ELEMENT}", 0)


def with_head(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``head``: the longest layout that a line's shape begins with; null if there is none.

    Layouts of one first token are one row; their size decides how they are joined.
    """
    by_lead = found.groupBy(_lead(F.col("head")).alias("lead")).agg(F.array_sort(F.collect_set(F.struct((-F.length("head")).alias("size"), "head"))).alias("heads"))
    whole = skeleton(F.col("shape"))
    own = F.filter("heads", lambda h: F.when(F.col("whole").isNotNull(), h["head"] == F.col("whole")).otherwise(F.startswith(F.col("shape"), h["head"]) & ~_keyed(h["head"])))
    joined = lines.withColumns({"lead": _lead(F.col("shape")), "whole": whole}).join(by_lead, "lead", "left")
    return joined.withColumn("head", F.get(own, F.lit(0))["head"]).drop("lead", "whole", "heads")


def level_of(text: Column, head: Column) -> Column:
    low = F.lower(text)
    out = F.when(head.startswith("<"), F.get(F.array(*[F.lit(s) for s in SEVERITIES]), F.pmod(text.try_cast("int"), F.lit(8))))
    for level, words in LEVELS.items():
        out = out.when(low.isin(*words), level)
    return F.coalesce(out, F.lit(""))


def _nearest(candidates: list[Column], near: Column) -> Column:
    return F.array_min(F.filter(F.array(*[F.struct(F.abs(c - near).alias("far"), c.alias("at")) for c in candidates]), lambda s: s["at"].isNotNull()))["at"]


def time_ms(text: Column, near: Column) -> Column:
    """Unix ms of a header's time in any of the known forms; ``near`` decides what the date lacks."""
    sub = lambda a, n: F.substring(text, a, n)
    month = lambda name: F.lpad(((F.instr(F.lit(MONTHS), name) + 2) / 3).cast("int").cast("string"), 2, "0")
    millis = lambda s: F.unix_millis(s.try_cast("timestamp"))
    dotted = F.translate(text, ",/", ".-")
    zoned = F.when(text.rlike(r"(?:Z|[+-]\d\d:?\d\d)$") & ~text.rlike(r"\d\d:\d\d$") | text.rlike(r"\d[+-]\d\d:\d\d$"), dotted).otherwise(F.concat(dotted, F.lit("Z")))
    zoned = F.regexp_replace(zoned, r"([+-]\d\d)(\d\d)$", "$1:$2")
    fraction = F.translate(F.substring(text, 16, 10), ",", ".")
    apache = F.concat(sub(8, 4), F.lit("-"), month(sub(4, 3)), F.lit("-"), sub(1, 2), F.lit("T"), sub(13, 8), sub(22, 3), F.lit(":"), sub(25, 2))
    rfc = F.regexp_replace(text, r"^[A-Z][a-z]{2}, ", "")
    parts = F.split(rfc, " ")
    zone = F.get(parts, F.lit(4))
    rfc_iso = F.concat(parts[2], F.lit("-"), month(parts[1]), F.lit("-"), F.lpad(parts[0], 2, "0"), F.lit("T"), parts[3], F.when(zone.rlike(r"^[+-]\d{4}$"), F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))).otherwise("Z"))
    compact = F.concat(sub(1, 4), F.lit("-"), sub(5, 2), F.lit("-"), sub(7, 2), F.lit("T"), sub(10, 2), F.lit(":"), sub(12, 2), F.lit(":"), sub(14, 2), fraction, F.lit("Z"))
    year = F.year(F.timestamp_millis(near))
    years = lambda rest: _nearest([millis(F.concat((year + y).cast("string"), F.lit("-"), rest, F.lit("Z"))) for y in (-1, 0, 1)], near)
    syslog = F.concat(month(sub(1, 3)), F.lit("-"), F.translate(sub(5, 2), " ", "0"), F.lit("T"), sub(8, 8))
    glog = F.concat(sub(2, 2), F.lit("-"), sub(4, 2), F.lit("T"), F.substring(text, 7, 20))
    clock = millis(F.concat(F.lit("1970-01-01T"), F.translate(text, ",", "."), F.lit("Z")))
    day = F.floor(near / 86_400_000)
    return (
        F.when(text.rlike(r"^\d{4}[-/]"), millis(zoned))
        .when(text.rlike(r"^\d\d/[A-Z]"), millis(apache))
        .when(text.rlike(r"^(?:[A-Z][a-z]{2}, )?\d\d? [A-Z]"), millis(rfc_iso))
        .when(text.rlike(r"^\d{8}-"), millis(compact))
        .when(text.rlike(r"^[A-Z]\d{4} "), years(glog))
        .when(text.rlike(r"^[A-Z][a-z]{2} "), years(syslog))
        .when(text.rlike(r"^\d\d:"), _nearest([(day + d) * 86_400_000 + clock for d in (-1, 0, 1)], near))
        .when(text.rlike(r"^\d{13}$"), text.try_cast("bigint"))
        .when(text.rlike(r"^\d{10}\."), F.floor(text.try_cast("decimal(20,9)") * 1000).cast("bigint"))
    )


def _message_lines(rows: DataFrame, document: str, near: Column, keep: list[Column]) -> DataFrame:
    """Kept columns, ``near`` and ``msg`` of documents that are JSON with a text message."""
    # exploded, so that conditions on what is parsed don't parse it again for themselves
    read = rows.select(*keep, near.alias("fallback"), F.explode(F.array(F.try_parse_json(document))).alias("v")).where("v is not null")
    text = F.try_variant_get("v", "$.msg", "string")
    names = [c for c in read.columns if c not in ("fallback", "v")]
    return read.select(*names, F.coalesce(F.try_variant_get("v", "$.ts", "bigint"), "fallback").alias("near"), text.alias("msg")).where("msg is not null")


def message_of(line: Column, head: Column) -> Column:
    """What a header line says: the text after its head, or the text field of keys and values."""
    plain = F.regexp_replace(head, r"([\\\[\](){}.*+?^$|#-])", r"\\$1")
    kinds = {TIME: _TIME, GTIME: _GTIME[1:], LEVEL: f"(?:{_LEVEL})", NAME: _NAME, WORD: _WORD, HOST: r"\S+", PROGRAM: r"[^\s\[]+", " ": r"[ \t]+"}
    for mark, pattern in kinds.items():
        plain = F.replace(plain, F.lit(mark), F.lit(pattern))
    keyed = F.regexp_extract(line, r'(?:^| )(?:msg|message|text)="([\s\S]*?)(?<!(?<!\\)\\)"', 1)
    return (
        F.when(line.startswith('{"'), F.coalesce(F.get_json_object(line, "$.msg"), F.get_json_object(line, "$.message"), F.get_json_object(line, "$.text")))
        .when(head.contains("="), F.regexp_replace(keyed, r"\\(.)", "$1"))
        .otherwise(F.regexp_replace(line, F.concat(F.lit("^"), plain), F.lit("")))
    )


_ROLES = ["time_text", "level_text", "name_text", "near", "head"]


def parsed_records(records: DataFrame, texts: bool = False) -> DataFrame:
    """Lines of single-record entries, shaped and written."""
    read = _message_lines(records, "d", F.unix_millis(F.col("received_at").cast("timestamp")), [F.col("rec_no").alias("id"), "stream_id"])
    first = read.withColumns({"line": F.substring_index("msg", "\n", 1), "rest": F.expr("substring(msg, length(substring_index(msg, '\\n', 1)) + 1)")})
    return written(with_shapes(first).select("stream_id", "id", "near", "bare", "shape", *["line", "rest"] * texts), "records")


def parsed_results(results: DataFrame, texts: bool = False) -> DataFrame:
    """Lines of streams in ranges of (stream, document id), shaped and written."""
    spread = results.select("stream_id", "document_id", "document").repartitionByRange("stream_id", "document_id").withColumn(PIECE, F.spark_partition_id())
    read = _message_lines(spread, "document", F.shiftright("document_id", 20), [F.col("stream_id"), F.col("document_id").alias("id"), F.col(PIECE)])
    return written(with_shapes(read.withColumn("line", F.col("msg"))).select(PIECE, "stream_id", "id", "near", "bare", "shape", *["line"] * texts), "results")


def entries(records: DataFrame, results: DataFrame, texts: bool = False) -> DataFrame:
    """Each entry: (tab, stream_id, first_id, last_id, ts_ms, lvl, component), with texts also message.

    A stream's lines lie in ranges; entries are numbered by prefix sums of their headers over the
    ranges, so that a stream of any length is never in one task.
    """
    single, lines = parsed_records(records, texts), parsed_results(results, texts)
    found = mined(shape_counts(single.select("shape").unionAll(lines.select("shape"))))
    fields = [time_ms(F.col("time_text"), F.col("near")).alias("ts_ms"), level_of(F.col("level_text"), F.col("head")).alias("lvl"), F.coalesce("name_text", F.lit("")).alias("component")]
    said = lambda rest: [F.concat(message_of(F.col("line"), F.col("head")), rest).alias("message")] if texts else []
    one = with_fields(with_head(single, found).where("head is not null")).select(F.lit("wal_records").alias("tab"), "stream_id", F.col("id").alias("first_id"), F.col("id").alias("last_id"), *fields, *said(F.col("rest")))

    starts = F.when(F.col("head").isNotNull(), 1)
    marked = with_fields(with_head(lines, found)).withColumns({"key": null_safe(F.col("stream_id")), "starts": starts}).select(PIECE, "key", "stream_id", "id", "starts", *_ROLES, *["line"] * texts)
    inside = Window.partitionBy(PIECE, "key").orderBy("id")
    fresh = marked.withColumn("twin", F.lag("id").over(inside).eqNullSafe(F.col("id")) & (F.row_number().over(inside) > 1)).where("not twin")
    begun = fresh.withColumn("begun", F.sum(F.coalesce("starts", F.lit(0))).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    numbers = with_offset(begun, piece_offsets(begun.groupBy(PIECE, "key").agg(F.max("begun").alias("n")), "key", "n"), "key")
    kept = [*_ROLES, *["line"] * texts]
    at = F.when(F.col("starts") == 1, F.struct(*kept))
    more = [F.array_sort(F.collect_list(F.when(F.col("starts").isNull(), F.struct("id", "line")))).alias("more")] * texts
    many = (
        numbers.withColumn("entry", F.col("begun") + F.col("_offset"))
        .where("entry > 0")
        .groupBy("key", "entry")
        .agg(F.first("stream_id").alias("stream_id"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.first(at, ignorenulls=True).alias("at"), *more)
        .select("stream_id", "first_id", "last_id", "at.*", *["more"] * texts)
        .select(F.lit("query_results").alias("tab"), "stream_id", "first_id", "last_id", *fields, *said(F.array_join(F.transform("more", lambda m: F.concat(F.lit("\n"), m["line"])), "") if texts else None))
    )
    return one.unionAll(many)
