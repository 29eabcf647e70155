"""Roll-ups over a package's findings and chains of findings that belong together.

Chains change findings, so they come last and in order: exfiltration, then activity on its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import CREDENTIAL_LABELS
from ..schema import severity_rank
from .base import exploded, listed, struct_of
from .patterns import has_sink

# What the label of a finding must say to join an exfiltration chain.
NETWORK_WORDS = ["remote code", "dead-drop", "network", "exfil"]


def _serious(f) -> Column:
    return severity_rank(f("severity")) >= 3


def fails_secrets(f) -> Column:
    """Whether a finding before or of the base64 scan speaks against VTD-0091; f gives its fields."""
    return ((f("category") == "security") & (f("phase") < 180) & _serious(f)) | ((f("phase") == 180) & (f("rule_id") == "VTD-0077"))


def fails_behavior(f) -> Column:
    return (f("phase") == 200) & _serious(f)


def rollup_structs() -> tuple[Column, Column]:
    return (
        struct_of(190, "VTD-0091", "security", "info", "No secrets or unsafe code patterns detected", F.lit("Scanned all files for credentials, private keys, and code-level risks (eval, shell exec, destructive ops)")),
        struct_of(210, "VTD-0092", "security", "info", "No prompt injection or jailbreak signals detected", F.lit("Scanned text content for instruction override, jailbreak framing, credential solicitation, and embedded injection markers")),
    )


def rollups(packages: DataFrame, findings: DataFrame) -> DataFrame:
    """VTD-0091 where no security finding before the base64 scan is high or worse and none is hidden code;
    VTD-0092 where no behavioral finding is high or worse."""
    failed = findings.groupBy("package_id").agg(F.bool_or(fails_secrets(F.col)).alias("s"), F.bool_or(fails_behavior(F.col)).alias("b"))
    secrets, behavior = rollup_structs()
    clean = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return exploded(packages.join(failed, "package_id", "left"), listed(F.when(clean("s"), secrets), F.when(clean("b"), behavior)))


def is_source(f) -> Column:
    """Whether a finding says that a file reads a credential."""
    return F.coalesce((f("category") == "security") & (f("severity") != "info") & X.contains_any(f("label"), CREDENTIAL_LABELS) & f("detail").startswith("Detected in "), F.lit(False))


def joins_exfiltration(f) -> Column:
    """Whether a finding in a file of an exfiltration chain is part of it."""
    return is_source(f) | F.coalesce(f("detail").startswith("Detected in ") & f("chain_id").isNull() & X.contains_any(F.lower(f("label")), NETWORK_WORDS), F.lit(False))


def exfiltration_struct(path: Column, chain: Column) -> Column:
    return struct_of(250, "VTD-0089", "security", "critical", "Credential access followed by network transmission", F.concat(path, F.lit(" reads a credential source and transmits data over the network. Common exfiltration pattern.")), filepath=path, intent="malicious", k1=path, chain_id=chain)


def is_strong(f) -> Column:
    """A finding that counts beside the buckets of a file."""
    return F.coalesce(_serious(f) & (f("intent") == "malicious") & f("chain_id").isNull() & f("bucket").isNull(), F.lit(False))


def joins_activity(f) -> Column:
    return (f("category") == "security") & f("bucket").isNotNull() & f("chain_id").isNull()


def activity_struct(path: Column, chain: Column, names: Column) -> Column:
    return struct_of(260, "VTD-0090", "security", "critical", "Multiple malicious-activity indicators in same file", F.concat(path, F.lit(" contains "), names, F.lit(" indicators that co-occur in a malicious pattern.")), filepath=path, intent="malicious", k1=path, chain_id=chain)


def exfiltration(findings: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings with exfiltration chains set, and the chains' own findings (VTD-0089)."""
    c = F.col
    sources = findings.where(is_source(c)).select("package_id", F.col("detail_path").alias("path")).distinct()
    sent = c("sink") if "sink" in files.columns else has_sink(c("content"))
    sinks = files.join(sources, ["package_id", "path"], "left_semi").where(sent).select("package_id", "path")
    chained = sinks.withColumn("__n", F.row_number().over(Window.partitionBy("package_id").orderBy("path")) - 1).select("package_id", c("path").alias("detail_path"), F.concat(F.lit("cred-exfil-"), c("__n").cast("string")).alias("__chain"))
    rows = findings.join(chained, ["package_id", "detail_path"], "left")
    hit = c("__chain").isNotNull() & joins_exfiltration(c)
    tagged = rows.withColumns({"chain_id": F.when(hit, c("__chain")).otherwise(c("chain_id")), "intent": F.when(hit, F.lit("malicious")).otherwise(c("intent")), "severity": F.when(hit, F.lit("critical")).otherwise(c("severity"))}).drop("__chain")
    return tagged, exploded(chained, listed(exfiltration_struct(c("detail_path"), c("__chain"))))


def activity(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings with activity chains set, and the chains' own findings (VTD-0090)."""
    c = F.col
    on = findings.where("category = 'security' and detail_path is not null")
    # a file's buckets come in the order of their first findings: five different names at most are gathered
    order = F.struct("phase", "k1", "k2")
    firsts = on.where("bucket is not null").groupBy("package_id", "detail_path", "bucket").agg(F.min(order).alias("o")).groupBy("package_id", "detail_path").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "bucket"))), lambda s: s["bucket"]).alias("__b"))
    strong = on.where(is_strong(c)).select("package_id", "detail_path").distinct().withColumn("__strong", F.lit(True))
    per = firsts.join(strong, ["package_id", "detail_path"], "left").where((F.size("__b") >= 2) | c("__strong"))
    chained = per.withColumn("__n", F.row_number().over(Window.partitionBy("package_id").orderBy("detail_path")) - 1).select("package_id", "detail_path", F.concat(F.lit("mal-activity-"), c("__n").cast("string")).alias("__chain"), F.array_join("__b", " + ").alias("__names"))
    rows = findings.join(chained, ["package_id", "detail_path"], "left")
    hit = c("__chain").isNotNull() & joins_activity(c)
    tagged = rows.withColumns({"chain_id": F.when(hit, c("__chain")).otherwise(c("chain_id")), "intent": F.when(hit, F.lit("malicious")).otherwise(c("intent")), "severity": F.when(hit, F.lit("critical")).otherwise(c("severity"))}).drop("__chain", "__names")
    return tagged, exploded(chained, listed(activity_struct(c("detail_path"), c("__chain"), c("__names"))))


#: The phase of rows that only say that a file sends; they are no findings.
SENDS = -1


def sends_struct(path: Column, sink: Column) -> Column:
    return F.when(sink, struct_of(SENDS, "", "", "info", "", "", detected_in=path))


def concluded(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """All findings of packages in one pass over one shuffle.  rows: the checks' findings, the marks of files
    that send, and for every package both roll-ups and its mismatch, if its description would give one, as though
    they held.  Chains are tagged file by file (windows over a package's rows, which spill), and of
    the conditional findings those that do not hold are dropped.

    Findings shrink some twentyfold on their way through the shuffle, so tasks that adaptive execution cuts by their
    compressed size hold ever more rows as the input grows; `tasks` fixes their number."""
    c = F.col
    package, file = Window.partitionBy("package_id"), Window.partitionBy("package_id", "detail_path")
    ever = lambda x, over: F.coalesce(F.max(x).over(over), F.lit(False))
    order = F.struct("phase", "k1", "k2")

    def tagged(df: DataFrame, hit: Column, chain: Column) -> DataFrame:
        return df.withColumn("__hit", hit).withColumns({"chain_id": F.when(c("__hit"), chain).otherwise(c("chain_id")), "intent": F.when(c("__hit"), F.lit("malicious")).otherwise(c("intent")), "severity": F.when(c("__hit"), F.lit("critical")).otherwise(c("severity"))}).drop("__hit")

    def number(on: str) -> Column:
        return F.dense_rank().over(Window.partitionBy("package_id", on).orderBy("detail_path")) - 1

    # one shuffle by package serves all windows
    dealt = rows.repartition(tasks, "package_id") if tasks else rows.repartition("package_id")
    df = dealt.withColumns({"__s": ever(fails_secrets(c), package), "__b": ever(fails_behavior(c), package), "__exfil": c("detail_path").isNotNull() & ever(is_source(c), file) & ever(c("phase") == SENDS, file)})
    df = df.withColumn("__x", F.when(c("__exfil"), F.concat(F.lit("cred-exfil-"), number("__exfil").cast("string"))))
    df = tagged(df, c("__exfil") & joins_exfiltration(c), c("__x"))
    df = df.withColumn("__new", F.row_number().over(Window.partitionBy("package_id", "detail_path", "bucket").orderBy("phase", "k1", "k2")) == 1)
    on = (c("category") == "security") & c("detail_path").isNotNull()
    firsts = F.collect_list(F.when(on & c("bucket").isNotNull() & c("__new"), F.struct(order.alias("o"), c("bucket").alias("b")))).over(file)
    df = df.withColumns({"__names": F.transform(F.sort_array(firsts), lambda s: s["b"]), "__strong": ever(on & is_strong(c), file), "__first": F.row_number().over(file.orderBy("phase", "k1", "k2")) == 1})
    df = df.withColumn("__active", c("detail_path").isNotNull() & ((F.size("__names") >= 2) | ((F.size("__names") >= 1) & c("__strong"))))
    df = df.withColumn("__a", F.when(c("__active"), F.concat(F.lit("mal-activity-"), number("__active").cast("string"))))
    df = tagged(df, c("__active") & joins_activity(c), c("__a"))
    df = df.withColumn("__bad", ever(c("__exfil") | c("__active") | ((c("category") == "security") & (c("intent") == "malicious") & (c("phase") >= 0)), package))
    holds = F.when(c("phase") == SENDS, F.lit(False)).when(c("phase") == 190, ~c("__s")).when(c("phase") == 210, ~c("__b")).when(c("phase") == 270, c("__bad")).otherwise(F.lit(True))
    own = F.struct(*[n for n in rows.columns if n != "package_id"])
    found = listed(
        F.when(holds, own), F.when(c("__exfil") & c("__first"), exfiltration_struct(c("detail_path"), c("__x"))),
        F.when(c("__active") & c("__first"), activity_struct(c("detail_path"), c("__a"), F.array_join("__names", " + "))),
    )
    return exploded(df, found)
