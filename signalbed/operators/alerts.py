"""Alerts: fan-out to rules, throttling, history, life cycle, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbed.functions.spacing import CHUNK_ROWS, keep_spaced
from signalbed.functions.times import MINUTE, instant, micros
from signalbed.session import cut_lineage

# Fixed values.
SEVERITIES = ("INFO", "WARNING", "CRITICAL")
CARD_COLOURS = {"INFO": "0076D7", "WARNING": "FFA500", "CRITICAL": "FF0000"}
#: Length of the short form of an alert's text, for callers that ask for it.
ALERT_TEXT = 200


def trigger_message(source: Column, limit: int | None = None) -> Column:
    """``Log entry [LEVEL] source: text``; with a ``limit``, a longer text is cut to it and marked."""
    text = F.coalesce("message", F.lit(""))
    if limit is not None:
        text = F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)
    return F.format_string("Log entry [%s] %s: %s", F.col("level"), F.coalesce(source, F.lit("unknown")), text)


def fan_out(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Every fired trap with each of its active rules.

    (trap_id, id, fired_at, message) joined to the rule columns.
    """
    fired = hits.select("trap_id", F.col("id").alias("entry_id"), F.col("timestamp").alias("fired_at"),
                        trigger_message(F.col("service_name")).alias("message"))
    active = rules.where("is_active").select("rule_id", "team_id", "trap_id", "channel_id", "severity", "throttle_minutes")
    return fired.join(active, "trap_id")


def not_recently_fired(fires: DataFrame, history: DataFrame) -> DataFrame:
    """Drop fires that lie less than the throttle time after the rule's last alert in ``history``."""
    last = history.groupBy("rule_id").agg(F.max("created_at").alias("_last"))
    rows = fires.join(last, "rule_id", "left")
    free_again = micros(F.col("_last")) + F.col("throttle_minutes").cast("long") * F.lit(MINUTE)
    return rows.where(F.col("_last").isNull() | (micros(F.col("fired_at")) >= free_again)).drop("_last")


def throttle(fires: DataFrame, history: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The fires that become alerts.

    A rule fires again once its throttle time has fully passed since its last
    alert. Of fires at one instant the lowest entry id is taken; a rule
    without throttle time lets everything through. Only (rule, time, entry) is
    walked; the texts are joined back for the fires that stay.
    """
    if history is not None:
        fires = not_recently_fired(fires, history)
    timed = cut_lineage(
        fires.where("throttle_minutes > 0").groupBy("rule_id", micros(F.col("fired_at")).alias("_at"))
        .agg(F.min("entry_id").alias("entry_id"), F.max("throttle_minutes").cast("long").alias("_minutes"))
    )
    times = timed.select("rule_id", "_at", (F.col("_minutes") * F.lit(MINUTE)).alias("_gap"))
    kept = keep_spaced(times, "rule_id", "_at", "_gap", chunk_rows)
    chosen = timed.join(kept, ["rule_id", "_at"], "left_semi").select("rule_id", "entry_id", F.lit(True).alias("_kept"))
    rows = fires.join(chosen, ["rule_id", "entry_id"], "left")
    return rows.where(F.col("_kept") | (F.col("throttle_minutes") <= 0)).select(*fires.columns)


def to_history(alerts: DataFrame) -> DataFrame:
    """History rows of new alerts."""
    return alerts.select(
        F.concat_ws("/", "rule_id", "entry_id").alias("id"), "team_id", "rule_id", "trap_id", "channel_id", "severity",
        F.lit("FIRED").alias("status"), "message", F.col("fired_at").alias("created_at"),
    )


def with_names(history: DataFrame, rules: DataFrame, traps: DataFrame, channels: DataFrame) -> DataFrame:
    return (
        history.join(rules.select("rule_id", F.col("name").alias("rule_name")), "rule_id")
        .join(traps.select("trap_id", F.col("name").alias("trap_name")), "trap_id")
        .join(channels.select("channel_id", F.col("name").alias("channel_name")), "channel_id")
    )


def history_rows(history: DataFrame, *, team_id=None, status=None, severity=None, rule_id=None, after=None) -> DataFrame:
    for name, value in {"team_id": team_id, "status": status, "severity": severity, "rule_id": rule_id}.items():
        if value is not None:
            history = history.where(F.col(name) == F.lit(value))
    return history if after is None else history.where(F.col("created_at") > instant(after))


def active_alert_counts(history: DataFrame, team_id) -> DataFrame:
    """Open alerts per severity, zero where there are none."""
    open_ = F.col("status").isin("FIRED", "ACKNOWLEDGED") & (F.col("team_id") == F.lit(team_id))
    counts = history.where(open_).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    rows = F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("active")) for s in SEVERITIES])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def apply_actions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Status of every alert after its actions.

    The first RESOLVED wins; acknowledgements before it overwrite each other;
    everything after it, and every FIRED, is rejected. A resolved alert that
    nobody acknowledged counts as acknowledged by the one who resolved it.
    ``alerts`` is (alert_id, status), ``actions`` (alert_id, action_id, status, user_id, at).
    """
    order = F.struct("at", "action_id")
    open_alerts = alerts.where("status <> 'RESOLVED'").select("alert_id")
    who = F.struct("at", "action_id", "user_id")
    usable = actions.join(open_alerts, "alert_id", "left_semi")
    resolved = usable.where("status = 'RESOLVED'").groupBy("alert_id").agg(F.min_by(who, order).alias("r"))
    rows = usable.join(resolved, "alert_id", "left").withColumn(
        "_in_time", F.col("r").isNull() | (order < F.struct("r.at", "r.action_id"))
    )
    acked = F.when((F.col("status") == "ACKNOWLEDGED") & F.col("_in_time"), order)
    taken = F.count_if(acked.isNotNull())
    folded = rows.groupBy("alert_id").agg(
        F.max_by(who, acked).alias("a"), F.first("r").alias("r"), taken.alias("_acks"), F.count(F.lit(1)).alias("_all")
    )
    done = F.col("r").isNotNull()
    return alerts.join(folded, "alert_id", "left").select(
        "alert_id",
        F.when(done, "RESOLVED").when(F.col("a").isNotNull(), "ACKNOWLEDGED").otherwise(F.col("status")).alias("status"),
        F.coalesce("a.user_id", "r.user_id").alias("acknowledged_by"), F.coalesce("a.at", "r.at").alias("acknowledged_at"),
        F.col("r.user_id").alias("resolved_by"), F.col("r.at").alias("resolved_at"),
        F.coalesce(F.col("_acks") + done.cast("long"), F.lit(0)).alias("accepted_actions"),
    )


def rejected_actions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """The actions :func:`apply_actions` does not take, with the reason."""
    order = F.struct("at", "action_id")
    resolved = actions.where("status = 'RESOLVED'").groupBy("alert_id").agg(F.min(order).alias("_first"))
    rows = actions.join(alerts.select("alert_id", F.col("status").alias("_start")), "alert_id").join(resolved, "alert_id", "left")
    late = (F.col("_start") == "RESOLVED") | F.coalesce(order > F.col("_first"), F.lit(False))
    reason = F.when(F.col("status") == "FIRED", "cannot go back to FIRED").when(late, "alert is resolved")
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").drop("_start", "_first")


def outbox(history: DataFrame, channels: DataFrame, traps: DataFrame, title: str = "Log alert", service: str = "signalbed") -> DataFrame:
    """One message per alert and target with its JSON body; nothing is sent."""
    config = F.from_json("configuration", "recipients array<string>, subject_prefix string, url string, webhook_url string")
    rows = (
        history.join(channels.where("is_active").select("channel_id", "channel_type", config.alias("c")), "channel_id")
        .join(traps.select("trap_id", F.col("name").alias("trap_name")), "trap_id")
    )
    rows = rows.withColumn("_time", F.date_format(F.to_utc_timestamp("created_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    time = F.col("_time")
    heading = F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("trap_name"))

    def fact(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    def markdown(label: str, value: Column) -> Column:
        return F.struct(F.lit("mrkdwn").alias("type"), F.concat(F.lit(f"*{label}:* "), value).alias("text"))

    webhook = F.to_json(F.struct(
        "severity", F.col("trap_name").alias("trapName"), "message", time.alias("timestamp"), F.lit(service).alias("service"),
    ))
    colour = F.coalesce(*[F.when(F.col("severity") == name, code) for name, code in CARD_COLOURS.items()])
    card = F.to_json(F.struct(
        F.lit("MessageCard").alias("@type"), F.lit("http://schema.org/extensions").alias("@context"),
        colour.alias("themeColor"), F.lit(title).alias("summary"),
        F.array(F.struct(
            heading.alias("activityTitle"),
            F.array(fact("Severity", F.col("severity")), fact("Trap", F.col("trap_name")),
                    fact("Message", F.col("message")), fact("Time", time)).alias("facts"),
            F.lit(True).alias("markdown"),
        )).alias("sections"),
    ))
    chat = F.to_json(F.struct(
        F.concat(F.lit(f"{title}: "), heading).alias("text"),
        F.array(
            F.to_variant_object(F.struct(F.lit("header").alias("type"), F.struct(
                F.lit("plain_text").alias("type"), F.lit(title).alias("text")).alias("text"))),
            F.to_variant_object(F.struct(F.lit("section").alias("type"), F.array(
                markdown("Severity", F.col("severity")), markdown("Trap", F.col("trap_name")),
                markdown("Message", F.col("message"))).alias("fields"))),
        ).alias("blocks"),
    ))
    mail = F.concat(F.coalesce("c.subject_prefix", F.lit(f"[{title}]")), F.lit(" ["), F.col("severity"), F.lit("] "),
                    F.col("trap_name"), F.lit(" - "), F.col("message"))
    kind = F.upper("channel_type")
    body = F.when(kind == "WEBHOOK", webhook).when(kind == "TEAMS", card).when(kind == "SLACK", chat).otherwise(mail)
    targets = F.when(kind == "WEBHOOK", F.array("c.url")).when(kind == "EMAIL", F.col("c.recipients")).otherwise(F.array("c.webhook_url"))
    return rows.select(
        F.col("id").alias("alert_id"), "channel_id", kind.alias("channel_type"), F.explode(targets).alias("target"), body.alias("body")
    )
