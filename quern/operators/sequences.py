"""Ordered and stateful logic as windows: rates, sessions, n-grams, averages, cron, breakers, queues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import materialise, maybe_broadcast


def rate_counts(log: DataFrame, seconds: int = 60, limit: int = 2) -> DataFrame:
    """Requests of a client in the window that ends with each one, and whether they exceed the limit."""
    w = Window.partitionBy("client").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return log.select("client", "ts", F.count("*").over(w).alias("n")).withColumn("over", F.col("n") > limit)


def sessions(log: DataFrame, gap: str = "86400 seconds") -> DataFrame:
    """(client, start, last, n) of runs of requests without a longer gap."""
    s = F.session_window("ts", gap)
    return log.groupBy("client", s).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("session_window")


def follow_ups(log: DataFrame, key: str = "user_id") -> DataFrame:
    """How often an action follows another of the same user."""
    w = Window.partitionBy(key).orderBy("ts", "id")
    return log.select("action", F.lead("action").over(w).alias("next")).where("next IS NOT NULL").groupBy("action", "next").agg(F.count("*").alias("n"))


def ngrams(lists: DataFrame, least: int = 2, most: int = 4) -> DataFrame:
    """(gram, n): counts of runs of ``least`` to ``most`` names in the arrays ``names``."""
    n = F.size("names")
    grams = F.flatten(F.transform(F.sequence(F.lit(least), F.lit(most)), lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.array_join(F.slice("names", i + 1, k), "->"))).otherwise(F.array().cast("array<string>"))))
    return lists.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def recent_lists(lists: DataFrame, since, last: int = 200) -> DataFrame:
    """The newest lists (user_id, at, names) of each user from a day on, ``last`` of them, those of one name left out."""
    w = Window.partitionBy("user_id").orderBy(F.desc("at"))
    kept = lists.where((F.col("at") >= since) & (F.size("names") >= 1)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    return kept.where(F.size("names") >= 2).drop("_n")


def repeated_patterns(lists: DataFrame, minimum: int = 3, k: int = 5) -> DataFrame:
    """The k most frequent patterns, none inside one that is kept; ties: shorter first, then text.

    The counts are written once. Each of k passes takes the first pattern that isn't inside one taken before, so nothing is
    left out however many patterns hold each other, and each pass shuffles one row a task.
    """
    counted = materialise(ngrams(lists).where(F.col("n") >= minimum).withColumn("len", F.size(F.split("gram", "->"))), "patterns")
    kept: list = []
    while len(kept) < k:
        inside = reduce(lambda a, b: a | b, (F.contains(F.lit(r["gram"]), F.col("gram")) for r in kept), F.lit(False))
        found = counted.where(~inside).orderBy(F.desc("n"), "len", "gram").limit(1).collect()  # one row
        if not found:
            break
        kept += found
    return lists.sparkSession.createDataFrame([(r["gram"], r["n"]) for r in kept], "gram string, n bigint")


def ema(log: DataFrame, alpha: float = 0.3, digits: int = 6) -> DataFrame:
    """Exponential average of each user's values in order; the first one seeds it. Weights have a closed form, so it is a sum.

    The i-th of n values weighs alpha * (1 - alpha) ** (n - i), the first (1 - alpha) ** (n - 1).
    """
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    numbered = log.select("user_id", "value", F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy("user_id")).alias("n"))
    weight = F.pow(F.lit(1 - alpha), F.col("n") - F.col("i")) * F.when(F.col("i") == 1, 1.0).otherwise(alpha)
    return numbered.groupBy("user_id").agg(F.round(F.sum(F.col("value") * weight), digits).alias("ema"), F.count("*").alias("n"))


def char_budget(rows: DataFrame, most: int, by: str = "user_id") -> DataFrame:
    """Rows in order until the running length would pass ``most``; nothing after the first that doesn't fit."""
    w = Window.partitionBy(by).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("total", F.sum(F.length("content")).over(w)).where(F.col("total") <= most)


def ring(log: DataFrame, n: int = 50, by: str = "user_id") -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("id"))
    return log.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def streaks(log: DataFrame, by: str = "user_id") -> DataFrame:
    """Each row with the number of failures in a row that end with it (0 after a success)."""
    w = Window.partitionBy(by).orderBy("ts", "id")
    island = F.sum(F.col("success")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = log.withColumn("_i", island)
    run = F.sum(1 - F.col("success")).over(Window.partitionBy(by, "_i").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("streak", run).drop("_i")


def backoff(streak: Column, base: int = 30, most: int = 3600) -> Column:
    """Seconds to wait: base doubled with each failure in a row, capped."""
    return F.when(streak > 0, F.least(base * F.pow(F.lit(2.0), streak - 1), F.lit(float(most)))).otherwise(0.0)


def health(streak: Column, down: int = 3) -> Column:
    return F.when(streak >= down, "down").when(streak > 0, "degraded").otherwise("healthy")


FIELDS = ("minute", "hour", "day", "month", "weekday")


def cron(expression: str, ts: Column) -> Column:
    """A predicate on a timestamp for five fields of *, */n, lists, ranges or numbers; weekday 0 (or 7) is Sunday."""
    parts = expression.split()
    if len(parts) != 5:
        raise ValueError(f"a cron expression has five fields: {expression}")
    have = {"minute": F.minute(ts), "hour": F.hour(ts), "day": F.dayofmonth(ts), "month": F.month(ts), "weekday": F.dayofweek(ts) - 1}

    def one(name: str, spec: str) -> Column:
        sunday = lambda v: 0 if name == "weekday" and v == 7 else v
        if spec == "*":
            return F.lit(True)
        if spec.startswith("*/"):
            return have[name] % int(spec[2:]) == 0
        if "," in spec and "-" in spec:
            raise ValueError(f"lists of ranges aren't part of the grammar: {spec}")
        if "," in spec:
            return have[name].isin(*{sunday(int(v)) for v in spec.split(",")})
        if "-" in spec:
            low, high = map(int, spec.split("-"))
            return have[name].between(low, high)
        return have[name] == sunday(int(spec))

    return reduce(lambda a, b: a & b, (one(n, p) for n, p in zip(FIELDS, parts, strict=True)))


RANGES = {"minute": (0, 59), "hour": (0, 23), "day": (1, 31), "month": (1, 12), "weekday": (0, 6)}


def field_values(name: str, spec: str) -> list[int]:
    """The numbers that a field of ``cron`` allows, in order."""
    low, high = RANGES[name]
    every = range(low, high + 1)
    if spec == "*":
        return list(every)
    if spec.startswith("*/"):
        return [v for v in every if v % int(spec[2:]) == 0]
    if "," in spec and "-" in spec:
        raise ValueError(f"lists of ranges aren't part of the grammar: {spec}")
    if "-" in spec:
        first, last = map(int, spec.split("-"))
        return [v for v in every if first <= v <= last]
    return sorted({0 if name == "weekday" and int(v) == 7 else int(v) for v in spec.split(",")} & set(every))


def successors(values: list[int], n: int) -> Column:
    """For each number from 0 to n the least of ``values`` that isn't below it, or null."""
    return F.array(*(F.lit(min((v for v in values if v >= k), default=None)).cast("int") for k in range(n + 1)))


def matching_days(rows: DataFrame, fields: dict[str, list[int]], days: int) -> DataFrame:
    """(day, here, after): for each day from the first to the last of ``rows`` the first matching one from it on, and after it."""
    span = rows.agg(F.min("ts").cast("date").alias("a"), F.max("ts").cast("date").alias("b")).where("a IS NOT NULL")
    each = span.select(F.explode(F.sequence("a", F.date_add("b", days + 2))).alias("day"))
    fits = F.dayofmonth("day").isin(fields["day"]) & F.month("day").isin(fields["month"]) & (F.dayofweek("day") - 1).isin(fields["weekday"])
    # one row a day
    on = Window.orderBy("day").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    here = each.withColumn("here", F.min(F.when(fits, F.col("day"))).over(on))
    return here.withColumn("after", F.lead("here").over(Window.orderBy("day")))


def next_run(rows: DataFrame, expression: str, hours: int = 366 * 24) -> DataFrame:
    """(id, ts, next_run_at): the first matching minute after ``ts`` within the horizon, else null.

    Minutes and hours come from tables of successors, days from a table of the days that the rows span, with each one's next
    matching day; nothing is spelt out by row.
    """
    fields = {name: field_values(name, spec) for name, spec in zip(FIELDS, expression.split(), strict=True)}
    minutes, hours_ = successors(fields["minute"], 60), successors(fields["hour"], 24)
    days = maybe_broadcast(materialise(matching_days(rows, fields, hours // 24 + 1), "matching-days"))
    start = F.date_trunc("minute", F.col("ts").cast("timestamp")) + F.make_dt_interval(mins=F.lit(1))
    timed = rows.select("id", "ts", start.alias("start")).withColumn("day", F.col("start").cast("date")).join(days, "day", "left")
    h, today = F.hour("start"), F.col("here") == F.col("day")
    at = lambda array, k: F.get(array, k)
    this_hour, minute = today & (at(hours_, h) == h), at(minutes, F.minute("start"))
    hour = F.when(this_hour, at(hours_, h + 1)).otherwise(at(hours_, h))
    moment = lambda day, hour, minute: F.struct(day.alias("day"), hour.alias("hour"), minute.alias("minute"))
    first = at(minutes, F.lit(0))
    found = F.when(this_hour & minute.isNotNull(), moment(F.col("day"), h, minute)).when(today & hour.isNotNull(), moment(F.col("day"), hour, first)).otherwise(moment(F.when(today, F.col("after")).otherwise(F.col("here")), at(hours_, F.lit(0)), first))
    when = F.col("f.day").cast("timestamp") + F.make_dt_interval(hours=F.col("f.hour"), mins=F.col("f.minute"))
    timed = timed.select("id", "ts", "start", found.alias("f")).withColumn("when", when)
    return timed.select("id", "ts", F.when(F.col("when") <= F.col("start") + F.make_dt_interval(hours=F.lit(hours)), F.col("when")).cast("timestamp_ntz").alias("next_run_at"))


def local_hours(ts: Column, start: str, end: str) -> Column:
    """Whether the time of day is in [start, end), which may wrap midnight."""
    minutes = lambda s: int(s[:2]) * 60 + int(s[3:])
    now = F.hour(ts) * 60 + F.minute(ts)
    a, b = minutes(start), minutes(end)
    return (now >= a) & (now < b) if a <= b else (now >= a) | (now < b)


def transition(status: Column, event: Column, recurring: Column) -> Column:
    """The next status of a task; null where the event doesn't apply."""
    return (
        F.when((event == "claim") & (status == "pending"), "running").when((event == "complete") & (status == "running"), F.when(recurring, "pending").otherwise("done"))
        .when((event == "fail") & (status == "running"), F.when(recurring, "pending").otherwise("failed")).when((event == "cancel") & status.isin("pending", "running"), "cancelled")
    )


def enqueue(queue: DataFrame, targets: DataFrame, batch: int = 20, cap: int = 200) -> DataFrame:
    """(target_id, batch_no): targets without an open or done task, at most ``cap``, in batches."""
    fresh = targets.join(queue.where(F.col("status").isin("pending", "running", "done")).select("target_id"), "target_id", "left_anti").orderBy("target_id").limit(cap)
    return fresh.select("target_id", F.floor((F.row_number().over(Window.orderBy("target_id")) - 1) / batch).alias("batch_no"))


def retries(status: Column, retry_count: Column, most: int = 3) -> Column:
    return F.when((status == "failed") & (retry_count < most), "pending").otherwise(status)


def tool_call(text: Column) -> Column:
    """struct<name, arguments> from JSON, a fenced block of JSON or single-quoted JSON; null where there is none."""
    shape = "name string, arguments string"
    parse = lambda t: F.when(F.from_json(t, shape)["name"].isNotNull(), F.from_json(t, shape))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    return F.coalesce(parse(text), parse(fenced), parse(F.translate(text, "'", '"')))


#: Words of schedules, in the order in which they are tried.
DAILY = r"(?:каждый\s*день|ежедневно|daily|dayly|every\s*day)"
CLOCK = r"(?:\s+(?:в|at))?\s+(\d{1,2})[:.](\d{2})"
HOUR = r"(?:\s+(?:в|at))?\s+(\d{1,2})(?:\s|$)"
EACH_MINUTES, EACH_HOURS = r"(?:каждые?|every)\s+(\d+)\s*(?:мин|min)", r"(?:каждые?|every)\s+(\d+)\s*(?:час|hour|hr)"
EACH_MINUTE, EACH_HOUR = r"каждую\s*минуту|every\s*min", r"каждый\s*час|every\s*hour"
WORKDAYS = r"(?:по\s*будням|будни|weekdays?)"
DAYS = (
    (r"понедельник|monday|mon", 1), (r"вторник|tuesday|tue", 2), (r"сред[аы]|wednesday|wed", 3), (r"четверг|thursday|thu", 4),
    (r"пятниц[аы]|friday|fri", 5), (r"суббот[аы]|saturday|sat", 6), (r"воскресень[еям]|sunday|sun", 0),
)
AT = r"(\d{1,2})[:.](\d{2})"
#: Requests for one moment: they have no cron expression.
ONCE = r"(?:через|in|after)\s+\d+\s*(?:мин|min|час|hour|hr|сек|sec)|^\d{4}-\d{2}-\d{2}[t ]\d{2}:\d{2}"


def schedule(text: Column) -> Column:
    """The cron expression of a request in words (English or Russian); null where it names one moment or nothing."""
    s = F.lower(text)
    number = lambda p, k: F.regexp_replace(F.regexp_extract(s, p, k), "^0+(?=.)", "")
    timed = lambda p, rest: F.concat_ws(" ", number(p, 2), number(p, 1), F.lit(rest))
    ladder = [
        (r"^[\d*/,-]+(\s+[\d*/,-]+){4}$", s), (ONCE, F.lit(None)), (DAILY + CLOCK, timed(DAILY + CLOCK, "* * *")),
        (DAILY + HOUR, F.concat_ws(" ", F.lit("0"), number(DAILY + HOUR, 1), F.lit("* * *"))), (DAILY, F.lit("0 9 * * *")),
        (EACH_MINUTES, F.concat(F.lit("*/"), number(EACH_MINUTES, 1), F.lit(" * * * *"))), (EACH_HOURS, F.concat(F.lit("0 */"), number(EACH_HOURS, 1), F.lit(" * * *"))),
        (EACH_MINUTE, F.lit("* * * * *")), (EACH_HOUR, F.lit("0 * * * *")), (WORKDAYS + CLOCK, timed(WORKDAYS + CLOCK, "* * 1-5")),
        *((names, F.when(s.rlike(AT), timed(AT, f"* * {day}")).otherwise(f"0 9 * * {day}")) for names, day in DAYS),
    ]
    return reduce(lambda out, rung: out.when(s.rlike(rung[0]), rung[1]), ladder[1:], F.when(s.rlike(ladder[0][0]), ladder[0][1]))


def skill(calls: Column, request: Column, least: int = 3) -> Column:
    """struct<name, steps> of a run of calls (array<struct<name, input: map>>): long values become placeholders."""
    steps = F.transform(calls, lambda c: F.struct(c["name"].alias("tool"), F.transform_values(c["input"], lambda k, v: F.when(F.length(v) > 20, F.concat(F.lit("{{"), k, F.lit("}}"))).otherwise(v)).alias("params")))
    words = F.filter(F.slice(F.regexp_extract_all(request, F.lit(r"\S+"), F.lit(0)), 1, 5), lambda w: w.rlike(r"^[\p{L}\p{N}]+$"))
    name = F.substring(F.array_join(F.transform(words, F.lower), "_"), 1, 50)
    return F.when(F.size(calls) >= least, F.struct(F.when(name == "", "unnamed_skill").otherwise(name).alias("name"), steps.alias("steps")))


def config_diff(old: DataFrame, new: DataFrame, reloadable: tuple[str, ...] = ()) -> DataFrame:
    """(path, old, new, reloadable) of settings (path, value) that differ."""
    both = old.select("path", F.col("value").alias("old")).join(new.select("path", F.col("value").alias("new")), "path", "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("reloadable", F.split("path", r"\.")[0].isin(*reloadable))


def requests(events: DataFrame, as_of: Column) -> DataFrame:
    """Start and end rows (request_id, kind, ts) paired: state and seconds elapsed."""
    at = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("ts")))
    paired = events.groupBy("request_id").agg(at("start").alias("start"), at("end").alias("end"))
    state = F.when(F.col("end").isNotNull(), "done").when(F.col("start").isNull(), "queued").otherwise("active")
    return paired.select("request_id", state.alias("state"), F.timestamp_diff("SECOND", F.col("start"), F.coalesce("end", as_of)).alias("elapsed"))


def reap(rows: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """What is younger than ``days``."""
    return rows.where(F.col(ts) >= as_of - F.make_dt_interval(days=F.lit(days)))
