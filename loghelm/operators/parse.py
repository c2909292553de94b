"""Raw text to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.functions import text

# Year-less syslog line and month names.
SYSLOG = (
    r"^(\w{3})\s+"
    r"(\d{1,2})\s+"
    r"(\d{2}:\d{2}:\d{2})\s+"
    r"(\S+)\s+"
    r"([^\[\]:]+)"
    r"(?:\[(\d+)\])?:\s+"
    r"(.+)"
)
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
_SEP = "\x01"


def syslog_fields(lines: DataFrame, column: str = "value") -> DataFrame:
    """month, day, time, host, service, pid, message; other lines are dropped.

    One rewriting regex per line instead of seven extractions.
    """
    line = text.strip(F.col(column))
    marked = _SEP.join(f"${i}" for i in range(1, 8))
    parts = F.split(F.regexp_replace(F.col("_line"), SYSLOG, marked), _SEP, 7)
    names = ["month", "day", "time", "host", "service", "pid", "message"]
    return (
        lines.withColumn("_line", line)
        .where(F.col("_line").rlike(SYSLOG))
        .withColumn("_parts", parts)
        .select(
            *[c for c in lines.columns if c != column],
            *[F.col("_parts")[i].alias(n) for i, n in enumerate(names)],
        )
    )


def syslog_time(month: Column, day: Column, time: Column, reference_time: Column, roll_back: bool = True) -> Column:
    """Timestamp with the year taken from ``reference_time``.

    A time after the reference belongs to the year before. Anything that is no
    calendar time becomes the reference time.
    """
    month_no = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month).cast("int")
    clock = F.split(time, ":")
    second = F.try_element_at(clock, F.lit(3)).cast("int")

    def at(year: Column) -> Column:
        return F.when(
            second < 60,
            F.try_make_timestamp_ntz(
                year, F.nullif(month_no, F.lit(0)), day.cast("int"),
                clock[0].cast("int"), clock[1].cast("int"), second.cast("decimal(16,6)")),
        )

    this_year = at(F.year(reference_time))
    if roll_back:
        this_year = F.when(this_year > reference_time, at(F.year(reference_time) - 1)).otherwise(this_year)
    return F.coalesce(this_year, reference_time)


def parse_syslog(lines: DataFrame, reference_time: Column, column: str = "value", roll_back: bool = True) -> DataFrame:
    """Parsed log table: timestamp, host, service, pid (-1 when absent), message."""
    fields = syslog_fields(lines, column)
    keep = [c for c in fields.columns if c not in ("month", "day", "time", "host", "service", "pid", "message")]
    return fields.select(
        *keep,
        syslog_time(F.col("month"), F.col("day"), F.col("time"), reference_time, roll_back).alias("timestamp"),
        "host", "service",
        F.coalesce(F.nullif(F.col("pid"), F.lit("")).try_cast("int"), F.lit(-1)).alias("pid"),
        "message",
    )


def parse_bracketed(lines: DataFrame, column: str = "value") -> DataFrame:
    """``[time] LEVEL: text`` to timestamp, level and the addresses in the text."""
    line = F.col(column)
    before = F.split_part(line, F.lit("]"), F.lit(1))
    after = F.when(line.contains("]"), F.split_part(line, F.lit("]"), F.lit(2))).otherwise(line)
    return lines.select(
        *[c for c in lines.columns if c != column],
        F.replace(before, F.lit("["), F.lit("")).alias("timestamp"),
        F.replace(F.split_part(after, F.lit(":"), F.lit(1)), F.lit(" "), F.lit("")).alias("level"),
        F.coalesce(text.first_group(line, r"([0-9]{1,3}\.){3}[0-9]{1,3}"), F.lit("N/A")).alias("ip"),
    )


def trace_split(path: Column) -> Column:
    """TRAINING, VALIDATE, ATTACK or OTHER, by words in the path, in that order."""
    p = F.lower(path)
    return (
        F.when(p.contains("training"), "TRAINING")
        .when(p.contains("validate") | p.contains("validation"), "VALIDATE")
        .when(p.contains("attack"), "ATTACK")
        .otherwise("OTHER")
    )


def parse_traces(files: DataFrame, path: str = "filepath", content: str = "value", modified: str = "modified") -> DataFrame:
    """One record per trace file, labelled by its path."""
    return files.select(
        F.col(path).alias("filepath"),
        trace_split(F.col(path)).alias("split"),
        F.lower(F.col(path)).contains("attack").cast("int").alias("is_anomaly"),
        F.col(modified).alias("timestamp"),
        F.lit("ADFA").alias("host"),
        text.collapse(F.col(content)).alias("message"),
    )


def service_from_message(message: Column) -> Column:
    return (
        F.when(message.contains("ssh"), "sshd")
        .when(text.contains_any(message, ["httpd", "nginx", "apache"]), "httpd")
        .otherwise("system")
    )


def canonical_service(service: Column) -> Column:
    """Lower case with spelling variants of sshd merged."""
    name = F.lower(text.strip(service))
    return F.when(name.isin("ssshd", "ssh"), "sshd").otherwise(name)


def source_ip(message: Column) -> Column:
    return F.coalesce(text.ipv4(message), F.lit("unknown"))


def pid_from_message(message: Column) -> Column:
    return F.coalesce(text.first_group(message, text.PID_FIELD, 1).try_cast("int"), F.lit(0))


def block_id(message: Column) -> Column:
    return text.first_group(message, text.BLOCK_ID, 1)


def or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(text.strip(c), F.lit("")), F.lit("unknown"))


def retime(line: Column, at: Column) -> Column:
    """Replace the three leading tokens of a replayed line by a fresh time."""
    parts = F.split(line, " ", 4)
    stamp = F.date_format(at, "MMM dd HH:mm:ss")
    return F.concat_ws(" ", stamp, F.when(F.size(parts) >= 4, parts[3]).otherwise(line))


def json_events(lines: DataFrame, received_at: Column, column: str = "value") -> DataFrame:
    """Lines that are JSON objects, with the defaults of the live feed."""
    line = text.strip(F.col(column))
    schema = ("timestamp string, detected_at string, host string, service string, "
              "message string, prob_anomaly string, source string, _corrupt_record string")
    event = F.from_json(F.col("_line"), schema, {"mode": "PERMISSIVE"})
    return (
        lines.withColumn("_line", line)
        .where(F.col("_line").startswith("{") & F.col("_line").endswith("}"))
        .withColumn("_e", event)
        .where(F.col("_e").isNotNull() & F.col("_e._corrupt_record").isNull())
        .select(
            *[c for c in lines.columns if c != column],
            F.coalesce(F.nullif(F.col("_e.timestamp"), F.lit("")), F.nullif(F.col("_e.detected_at"), F.lit("")),
                       text.iso(received_at)).alias("timestamp"),
            F.coalesce("_e.host", F.lit("unknown")).alias("host"),
            F.coalesce("_e.service", F.lit("unknown")).alias("service"),
            F.coalesce("_e.message", F.lit("")).alias("message"),
            F.coalesce(F.col("_e.prob_anomaly").try_cast("double"), F.lit(0.0)).alias("prob_anomaly"),
            F.coalesce("_e.source", F.lit("upload")).alias("source"),
        )
    )
