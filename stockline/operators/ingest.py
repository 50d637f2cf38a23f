"""Ingest, change capture and replacement of current state."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import skew, times
from ..session import checkpointed

# Type codes that make event ids from observation numbers.
EVENT_CODES = {"new_product": 1, "price_change": 2, "status_change": 3, "restock": 4, "out_of_stock": 5, "store_restock": 6}


def clean_text(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(times.col(c), r"\s+", " "))


def status_code(c: str | Column) -> Column:
    """"1  General" -> "1"; blank -> null."""
    token = F.split(F.trim(times.col(c)), r"\s+")[0]
    return F.when(token != "", token)


def size_ml(name: str | Column) -> Column:
    """"750ml" -> 750, "1.75L" -> 1750."""
    name = times.col(name)
    ml = F.regexp_extract(name, r"(?i)(\d+(?:\.\d+)?)\s*ml\b", 1)
    litres = F.regexp_extract(name, r"(\d+(?:\.\d+)?)\s*L\b", 1)

    def half_up(c: Column) -> Column:
        return F.floor(c + 0.5).cast("int")

    return F.when(ml != "", half_up(ml.try_cast("double"))).when(litres != "", half_up(litres.try_cast("double") * 1000))


def vendor_code(raw: str | Column, name: str | Column) -> Column:
    """Digits without leading zeros; else the number closing the vendor's name."""
    digits = F.regexp_replace(F.regexp_replace(F.coalesce(times.col(raw), F.lit("")), r"\D", ""), "^0+", "")
    named = F.regexp_replace(F.regexp_extract(times.col(name), r"\((\d+)\)\s*$", 1), "^0+", "")
    return F.when(digits != "", digits).when(named != "", named)


def normalize_catalog(raw: DataFrame) -> DataFrame:
    """Raw rows ``(sku, name, display_group, status, store_qty, in_stock, ...)``."""
    name = clean_text("name")
    return raw.select(
        F.col("sku").alias("csc"),
        name.alias("name"),
        clean_text("display_group").alias("category"),
        status_code("status").alias("status"),
        size_ml(name).alias("size_ml"),
        "store_qty",
        F.coalesce("in_stock", F.coalesce("store_qty", F.lit(0)) > 0).alias("in_stock"),
    )


def dedup_source_rows(rows: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """The last arrival of each key wins."""
    return skew.latest(rows, keys, arrival)


def batch_quality_gate(
    previous: DataFrame,
    batch: DataFrame,
    expected: int,
    min_share: float = 0.95,
    max_drops: int = 200,
    max_drop_share: float = 0.02,
) -> DataFrame:
    """One row of measures and a verdict; the caller refuses to write on "reject"."""
    was = previous.select("csc", F.col("store_qty").alias("was"))
    joined = batch.select("csc", F.col("store_qty").alias("now")).join(was, "csc", "left")
    zero = F.lit(0)
    drops = joined.agg(
        F.count("*").alias("fetched"),
        F.count_if(F.coalesce("was", zero) > 0).alias("previously_in_stock"),
        F.count_if((F.coalesce("was", zero) > 0) & (F.coalesce("now", zero) == 0)).alias("drops_to_zero"),
        F.count_if(F.col("csc").isNull() | (F.col("csc") == "")).alias("empty_keys"),
        (F.count("csc") - F.countDistinct("csc")).alias("duplicate_keys"),
    )
    limit = F.greatest(F.lit(float(max_drops)), F.col("previously_in_stock") * max_drop_share)
    return drops.withColumn("drop_limit", limit).withColumn(
        "verdict",
        F.when(F.col("fetched") < expected * min_share, "reject: too few rows")
        .when(F.col("empty_keys") > 0, "reject: empty keys")
        .when(F.col("duplicate_keys") > 0, "reject: duplicate keys")
        .when(F.col("drops_to_zero") > F.col("drop_limit"), "reject: too many drops to zero")
        .otherwise("accept"),
    )


def accept_or_raise(gate: DataFrame) -> None:
    verdict = gate.first()["verdict"]
    if verdict != "accept":
        raise ValueError(verdict)


def _typed_events(prev_price: str, prev_status: str | None, prev_qty: str, known: Column) -> Column:
    """An array of (type, old, new) for one pair of states."""
    zero = F.lit(0)
    was, now = F.coalesce(prev_qty, zero), F.coalesce("store_qty", zero)

    def event(kind: str, old: Column, new: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("event_type"), old.cast("string").alias("old"), new.cast("string").alias("new")
        )

    none = F.lit(None)
    parts = [
        F.when(~known, event("new_product", none, F.col("price"))),
        F.when(known & (F.col(prev_price) != F.col("price")), event("price_change", F.col(prev_price), F.col("price"))),
        F.when(known & (was == 0) & (now > 0), event("restock", was, now)),
        F.when(known & (was > 0) & (now == 0), event("out_of_stock", was, now)),
    ]
    if prev_status is not None:
        parts.append(
            F.when(known & (F.col(prev_status) != F.col("status")), event("status_change", F.col(prev_status), F.col("status")))
        )
    return F.array_compact(F.array(*parts))


def snapshot_diff_events(previous: DataFrame, batch: DataFrame) -> DataFrame:
    """Typed events between two states ``(csc, price, status, store_qty)``."""
    was = previous.select(
        "csc",
        F.col("price").alias("p_price"),
        F.col("status").alias("p_status"),
        F.col("store_qty").alias("p_qty"),
        F.lit(True).alias("known"),
    )
    both = batch.join(was, "csc", "left")
    known = F.coalesce("known", F.lit(False))
    events = _typed_events("p_price", "p_status", "p_qty", known)
    return both.select("csc", F.explode(events).alias("e")).select("csc", "e.*")


def change_events(obs: DataFrame, max_gap_hours: int | None = None) -> DataFrame:
    """The whole change log of an observation history. Event ids are made from
    observation numbers, so that reruns name the same events. ``max_gap_hours``: a row
    that comes longer after the one before it renews the state and is no event."""
    pairs = skew.neighbours(
        obs, ["csc"], ["seen_at"], F.to_date("seen_at"), prev={"p_price": "price", "p_qty": "store_qty", "p_seq": "seq", "p_at": "seen_at"}
    )
    if max_gap_hours is not None:
        pairs = pairs.where(F.col("p_at").isNull() | (F.col("seen_at") <= F.col("p_at") + F.expr(f"interval {max_gap_hours} hours")))
    events = _typed_events("p_price", None, "p_qty", F.col("p_seq").isNotNull())
    number = F.create_map(*[F.lit(x) for kv in EVENT_CODES.items() for x in kv])
    return pairs.select("csc", "seen_at", "seq", F.explode(events).alias("e")).select(
        (F.col("seq") * 8 + F.element_at(number, F.col("e.event_type"))).alias("event_id"),
        "csc",
        F.col("e.event_type").alias("event_type"),
        F.col("e.old").alias("old"),
        F.col("e.new").alias("new"),
        F.col("seen_at").alias("created_at"),
    )


def suppress_after_gap(changes: DataFrame, runs: DataFrame, batch_at: datetime, gap_hours: int = 48) -> DataFrame:
    """No events on the first pass or when the last good pass is too old."""
    last_ok = (
        runs.where(F.col("ok") & (F.col("finished_at") < times.ts(batch_at))).agg(F.max("finished_at")).scalar()
    )
    return (
        changes.withColumn("__last", last_ok)
        .where(F.col("__last").isNotNull() & (F.col("__last") >= times.ago(batch_at, f"{gap_hours} hours")))
        .drop("__last")
    )


def delta_encode(history: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """Keeps a row only where a value differs from the key's previous row."""
    tagged = history.withColumn("__v", F.struct(*values))
    prev = skew.neighbours(tagged, keys, [at], F.to_date(at), prev={"__was": "__v"})
    return prev.where(F.col("__was").isNull() | ~F.col("__v").eqNullSafe(F.col("__was"))).drop("__v", "__was")


def upsert_latest(
    current: DataFrame,
    incoming: DataFrame,
    key: str,
    overwrite: Sequence[str] = (),
    keep_if_set: Sequence[str] = (),
    fill_if_new: Sequence[str] = (),
) -> DataFrame:
    """The merged table: ``overwrite`` takes the incoming value, ``keep_if_set``
    keeps a known one, ``fill_if_new`` takes the incoming value unless null."""
    c, i = current.alias("c"), incoming.withColumn("__in", F.lit(True)).alias("i")
    arrived = F.col("i.__in").isNotNull()
    return c.join(i, F.col(f"c.{key}") == F.col(f"i.{key}"), "full_outer").select(
        F.coalesce(f"c.{key}", f"i.{key}").alias(key),
        *[F.when(arrived, F.col(f"i.{x}")).otherwise(F.col(f"c.{x}")).alias(x) for x in overwrite],
        *[F.coalesce(f"c.{x}", f"i.{x}").alias(x) for x in keep_if_set],
        *[F.coalesce(f"i.{x}", f"c.{x}").alias(x) for x in fill_if_new],
    )


def mark_absent(listed: DataFrame, as_of: datetime, absent_hours: int = 24) -> DataFrame:
    """Keys not seen for a day are delisted and out of stock; never-seen keys stay."""
    gone = F.coalesce(F.col("last_seen") < times.ago(as_of, f"{absent_hours} hours"), F.lit(False))
    return listed.withColumn("delisted_at", F.when(gone, times.ts(as_of))).withColumn("in_stock", F.col("in_stock") & ~gone)


def remove_missing(registry: DataFrame, pull: DataFrame, key: str, as_of: datetime) -> DataFrame:
    """After a full pull: absent keys get ``removed_at``, returned ones lose it."""
    here = pull.select(key).distinct().withColumn("__here", F.lit(True))
    return (
        registry.join(here, key, "left")
        .withColumn(
            "removed_at",
            F.when(F.col("__here").isNull(), F.coalesce("removed_at", times.ts(as_of))),
        )
        .drop("__here")
    )


def zero_missing_children(store_now: DataFrame, pages: DataFrame) -> DataFrame:
    """Stores that held stock but are absent from their product's new page go to 0.

    ``pages``: (csc, store_id, checked_at), one row per store on the page."""
    checked = pages.groupBy("csc").agg(F.max("checked_at").alias("seen_at"))
    return (
        store_now.where("qty > 0")
        .select("csc", "store_id")
        .join(pages.select("csc", "store_id"), ["csc", "store_id"], "left_anti")
        .join(checked, "csc")
        .select("csc", "store_id", "seen_at", F.lit(0).alias("qty"))
    )


def store_restock_events(store_obs: DataFrame, max_age_hours: int = 168) -> DataFrame:
    """A store seen at 0 no more than ``max_age_hours`` ago that now has stock."""
    prev = skew.neighbours(
        store_obs, ["csc", "store_id"], ["seen_at"], F.to_date("seen_at"), prev={"prev_qty": "qty", "prev_at": "seen_at"}
    )
    fresh = F.col("prev_at") > F.col("seen_at") - F.expr(f"interval {max_age_hours} hours")
    return prev.where((F.col("prev_qty") == 0) & (F.col("qty") > 0) & fresh).select(
        (F.col("seq") * 8 + EVENT_CODES["store_restock"]).alias("event_id"),
        "csc",
        "store_id",
        "qty",
        F.col("seen_at").alias("created_at"),
        F.col("prev_at").alias("prev_checked_at"),
    )


def recheck_change_count(store_now: DataFrame, pages: DataFrame) -> DataFrame:
    """Per checked product: known stores whose count differs, plus stocked
    stores missing from the page. ``pages``: (csc, store_id, qty)."""
    known = store_now.select("csc", "store_id", F.col("qty").alias("was"))
    differs = (
        pages.join(known, ["csc", "store_id"])
        .where(~F.col("qty").eqNullSafe(F.col("was")))
        .select("csc")
    )
    vanished = (
        known.where("was > 0")
        .join(pages.select("csc").distinct(), "csc", "left_semi")
        .join(pages.select("csc", "store_id"), ["csc", "store_id"], "left_anti")
        .select("csc")
    )
    counted = differs.unionByName(vanished).groupBy("csc").agg(F.count("*").alias("changed"))
    return pages.select("csc").distinct().join(counted, "csc", "left").select("csc", F.coalesce("changed", F.lit(0)).alias("changed"))


def find_glitches(obs: DataFrame, max_minutes: int | None = None) -> DataFrame:
    """Zero rows between a positive before and a positive in the next row."""
    near = skew.neighbours(
        obs,
        ["csc"],
        ["seen_at"],
        F.to_date("seen_at"),
        prev={"prev_qty": "store_qty"},
        next={"next_qty": "store_qty", "next_at": "seen_at", "next_seq": "seq"},
    )
    odd = near.where("store_qty = 0 and prev_qty > 0 and next_qty > 0")
    if max_minutes is not None:
        odd = odd.where(F.col("next_at") <= F.col("seen_at") + F.expr(f"interval {max_minutes} minutes"))
    return odd


def repair_glitch(obs: DataFrame, max_minutes: int) -> DataFrame:
    """History without the glitched zero rows."""
    return obs.join(find_glitches(obs, max_minutes).select("seq"), "seq", "left_anti")


def drop_false_restocks(changes: DataFrame, obs: DataFrame, max_minutes: int) -> DataFrame:
    """The change log without the restocks that followed glitched zeros."""
    false_ids = find_glitches(obs, max_minutes).select(
        (F.col("next_seq") * 8 + EVENT_CODES["restock"]).alias("event_id")
    )
    return changes.join(false_ids, "event_id", "left_anti")


def _hash_halves(line: Column) -> list[Column]:
    """Two independent 60-bit numbers of a line, as decimals that can be added up."""
    digest = F.sha2(line, 256)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)") for at in (1, 16)]


def _joined_sums(a: Column, b: Column) -> Column:
    """One text of both sums: equal only if both are."""
    return F.concat_ws("-", a.cast("string"), b.cast("string"))


def month_manifest(lines: DataFrame) -> DataFrame:
    """Per month: lines, codes, reused codes, totals and an order-free content hash.

    The hash adds up per-line hashes as decimals, so that no month is gathered."""
    halves = _hash_halves(F.concat_ws("|", "line", "item_code", "bottles", "dollars"))
    per_code = lines.groupBy("period_month", "item_code").agg(
        F.count("*").alias("n"),
        F.sum("dollars").alias("dollars"),
        F.sum("bottles").alias("bottles"),
        *[F.sum(h).alias(f"h{i}") for i, h in enumerate(halves)],
    )
    return per_code.groupBy("period_month").agg(
        F.sum("n").alias("lines"),
        F.count("*").alias("item_codes"),
        F.count_if(F.col("n") > 1).alias("reused_codes"),
        F.sum("dollars").alias("sum_dollars"),
        F.sum("bottles").alias("sum_bottles"),
        _joined_sums(F.sum("h0"), F.sum("h1")).alias("content_hash"),
    )


def import_verdicts(manifest: DataFrame, links: DataFrame, stored: DataFrame, tolerance: float = 1.0, recheck: int = 2) -> DataFrame:
    """What to do with each month: import, unchanged, skip, or the problem.

    ``links``: (period_month, link_month, file_month, title_month, fiscal_month, reported_dollars);
    ``stored``: (period_month, content_hash). The newest ``recheck`` months are
    always read again. One row per month goes through the final ranking."""
    per_month = links.groupBy("period_month").agg(
        F.count("*").alias("n_links"),
        *[F.max(c).alias(c) for c in ("link_month", "file_month", "title_month", "fiscal_month", "reported_dollars")],
    )
    rows = per_month.join(manifest, "period_month", "left").join(
        stored.select("period_month", F.col("content_hash").alias("stored_hash")), "period_month", "left"
    )
    newest = F.row_number().over(Window.orderBy(F.col("period_month").desc())) <= recheck
    month = F.date_format("period_month", "yyyy-MM")
    agree = (F.col("link_month") == month) & (F.col("file_month") == month)
    titled = (F.col("title_month") == month) & (F.col("fiscal_month") == month)
    off = F.abs(F.col("sum_dollars").cast("double") - F.col("reported_dollars")) > tolerance
    return rows.withColumn("newest", newest).select(
        times.text("period_month").alias("period_month"),
        F.when(F.col("n_links") > 1, "problem: more than one link")
        .when(~F.coalesce(agree, F.lit(False)), "problem: link and file name differ")
        .when(F.col("stored_hash").isNotNull() & ~F.col("newest"), "skip")
        .when(F.col("lines").isNull(), "problem: no lines")
        .when(F.col("stored_hash") == F.col("content_hash"), "unchanged")
        .when(~F.coalesce(titled, F.lit(False)), "problem: title names another month")
        .when(F.col("reported_dollars").isNotNull() & off, "problem: lines do not add up")
        .otherwise("import")
        .alias("verdict"),
    )


def months_to_write(lines: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The lines of the months to import, ready for a partition overwrite."""
    chosen = verdicts.where("verdict = 'import'").select(F.to_date("period_month").alias("period_month"))
    return lines.join(chosen, "period_month", "left_semi")


def fiscal_label(day: str | Column) -> Column:
    """The fiscal label of a date; the year starts in July."""
    day = times.col(day)
    m = F.month(day)
    fy = F.year(day) + F.when(m >= 7, 1).otherwise(0)
    period = (m + 5) % 12 + 1
    return F.concat(F.lit("FY"), F.lpad((fy % 100).cast("string"), 2, "0"), F.lit(" P"), period.cast("string"))


def fiscal_to_month(label: str | Column) -> Column:
    """"FY27 P2" -> "2026-08"; periods outside 1-12 -> null."""
    label = times.col(label)
    fy = F.regexp_extract(label, r"(?i)FY(\d{2})[ _]*P(\d{1,2})", 1).try_cast("int")
    p = F.regexp_extract(label, r"(?i)FY(\d{2})[ _]*P(\d{1,2})", 2).try_cast("int")
    month = (p + 5) % 12 + 1
    year = 2000 + fy - F.when(p <= 6, 1).otherwise(0)
    return F.when(p.between(1, 12), F.format_string("%04d-%02d", year.cast("int"), month.cast("int")))


def text_to_month(label: str | Column) -> Column:
    """"August 2026", "Sept 2025" -> "YYYY-MM"."""
    label = times.col(label)
    word = F.lower(F.substring(F.regexp_extract(label, r"\b([A-Za-z]{3,9})\.?\s+(\d{4})\b", 1), 1, 3))
    year = F.regexp_extract(label, r"\b([A-Za-z]{3,9})\.?\s+(\d{4})\b", 2)
    names = F.array(*[F.lit(x) for x in "jan feb mar apr may jun jul aug sep oct nov dec".split()])
    at = F.array_position(names, word)
    return F.when(at > 0, F.concat(year, F.lit("-"), F.lpad(at.cast("string"), 2, "0")))


def unmatched_codes(sales: DataFrame, products: DataFrame, samples: int = 5) -> DataFrame:
    """Codes of the newest month the catalog does not list, with the first few."""
    newest = sales.agg(F.max("period_month")).scalar()
    codes = (
        sales.where(F.col("period_month") == newest)
        .groupBy("item_code")
        .agg(F.min_by("item_name", "line").alias("item_name"))
        .join(products.select(F.col("csc").alias("item_code")), "item_code", "left_anti")
    )
    shown = codes.orderBy("item_code").limit(samples)
    sample = shown.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "item_code", "item_name"))), "; ")).scalar()
    return codes.agg(F.count("*").alias("codes")).withColumn("sample", sample)


def reused_codes(sales: DataFrame) -> DataFrame:
    """Per month, the codes on more than one line."""
    return (
        sales.groupBy("period_month", "item_code")
        .agg(F.count("*").alias("n"))
        .groupBy("period_month")
        .agg(F.count("*").alias("codes"), F.count_if(F.col("n") > 1).alias("reused"))
        .withColumn("period_month", times.text("period_month"))
    )


def list_hashes(lists: DataFrame, by: str) -> DataFrame:
    """Order-free content hash of each posted list, and whether it differs from
    the one before. Line hashes are added up, so no list is gathered; lists, by date,
    are then compared year by year."""
    line = F.upper(F.concat_ws("|", "product_name", F.col("store_id").cast("string"), F.col("bottle_qty").cast("string")))
    per = lists.groupBy(by).agg(F.count("*").alias("rows"), _joined_sums(*[F.sum(h) for h in _hash_halves(line)]).alias("list_hash"))
    pairs = skew.neighbours(checkpointed(per), [], [by], F.year(by), prev={"__before": "list_hash"})
    return pairs.withColumn("changed", ~F.col("list_hash").eqNullSafe(F.col("__before"))).drop("__before")


def new_drop_products(stored: DataFrame, posted: DataFrame, today: Column) -> DataFrame:
    """One event row per drop date with the products not stored before; dates
    already past are not announced."""
    fresh = posted.join(stored.select("drop_date", "product_name", "store_id"), ["drop_date", "product_name", "store_id"], "left_anti")
    return (
        fresh.where(F.col("drop_date") >= today)
        .select("drop_date", "product_name")
        .distinct()
        .groupBy("drop_date")
        .agg(F.count("*").alias("new_products"), F.min("product_name").alias("first_product"))
    )


def third_saturday(day: str | Column) -> Column:
    month_start = F.to_date(F.date_trunc("month", times.col(day)))
    return F.date_add(F.next_day(F.date_sub(month_start, 1), "Sat"), 14)


def drop_calendar(days: DataFrame, day: str) -> DataFrame:
    """Third Saturday, next drop (the day itself still counts until the day
    after), and the drop a posted list belongs to (a week's tail)."""
    this = third_saturday(day)
    following = third_saturday(F.add_months(F.to_date(day), 1))
    at = F.col(day)
    return days.select(
        day,
        times.text(this).alias("third_saturday"),
        times.text(F.when(at > this.cast("timestamp_ntz") + F.expr("interval 1 day"), following).otherwise(this)).alias("next_drop"),
        times.text(F.when(at <= this.cast("timestamp_ntz") + F.expr("interval 7 days"), this).otherwise(following)).alias("current_drop"),
    )


_RECORD = (
    r"(?i)^(.*?)\s+-\s+(\d{6})\s+-\s+\$([\d,.]+)(?:\s+-\s+([\d,]+)\s+Bottles?)?(?:\s+-\s+([\d,]+)\s+Entr(?:y|ies))?"
)


def regex_line_records(lines: DataFrame, text: str) -> DataFrame:
    """"NAME - 018416 - $154.99 - 52 Bottles - 7102 Entries" -> typed columns."""
    line = clean_text(text)

    def part(i: int) -> Column:
        return F.regexp_extract(line, _RECORD, i)

    def number(i: int, kind: str) -> Column:
        return F.regexp_replace(part(i), ",", "").try_cast(kind)

    return lines.where(line.rlike(_RECORD)).select(
        part(2).alias("item_code"),
        clean_text(part(1)).alias("product_name"),
        number(3, "double").alias("price"),
        number(4, "int").alias("bottles"),
        number(5, "int").alias("entries"),
    )


_COLUMNAR = (
    "struct<totalCount: int, column: array<struct<nullIndex: array<int>, stringColumn: struct<values: array<string>>>>>"
)


def columnar_answers(responses: DataFrame, key: str, body: str) -> DataFrame:
    """One row per answer column; a guard prefix before the first brace is dropped.

    ``fits`` is false where values and gaps do not add up to the row count."""
    parsed = F.from_json(F.regexp_replace(body, r"^[^{]*", ""), _COLUMNAR)
    col = F.col("c.col")
    none = F.array().cast("array<int>")
    return (
        responses.select(key, parsed.alias("r"))
        .select(key, F.col("r.totalCount").alias("total"), F.posexplode("r.column").alias("column", "col"))
        .select(F.struct("*").alias("c"))
        .select(
            F.col(f"c.{key}").alias(key),
            F.col("c.column").alias("column"),
            F.col("c.total").alias("total"),
            F.coalesce(col["nullIndex"], none).alias("nulls"),
            F.coalesce(col["stringColumn"]["values"], F.array().cast("array<string>")).alias("values"),
        )
        .withColumn("fits", F.size("values") == F.col("total") - F.size("nulls"))
    )


def unpack_columnar(responses: DataFrame, key: str, body: str) -> DataFrame:
    """Rows ``(key, column, row, value)`` of columnar JSON answers.

    Values fill the row numbers that are not gaps, in order. A column whose
    values and gaps do not add up to the total fails the whole job."""
    answers = columnar_answers(responses, key, body)
    uneven = F.raise_error(F.concat(F.lit("column "), F.col("column").cast("string"), F.lit(" does not add up in "), F.col(key).cast("string")))
    answers = answers.withColumn("values", F.when(F.col("fits"), F.col("values")).otherwise(uneven)).where("total > 0")
    filled = F.array_except(F.expr("sequence(0, total - 1)"), F.col("nulls"))
    cells = F.concat(
        F.transform(
            F.arrays_zip(filled.alias("row"), F.col("values").alias("value")),
            lambda x: F.struct(x["row"].alias("row"), x["value"].alias("value")),
        ),
        F.transform("nulls", lambda i: F.struct(i.alias("row"), F.lit(None).cast("string").alias("value"))),
    )
    return answers.select(key, "column", F.explode(cells).alias("x")).select(key, "column", "x.row", "x.value")


def run_log_freshness(runs: DataFrame, budgets: DataFrame, as_of: datetime) -> DataFrame:
    """Last success per job against its budget in hours; jobs that never ran are stale."""
    last = runs.groupBy("job").agg(F.max(F.when(F.col("ok"), F.col("finished_at"))).alias("last_ok"))
    age = times.hours_between(times.ts(as_of), "last_ok")
    return budgets.join(last, "job", "left").select(
        "job",
        "max_age_hours",
        "last_ok",
        F.round(age, 4).alias("age_hours"),
        F.coalesce(age > F.col("max_age_hours"), F.lit(True)).alias("stale"),
    )


def with_placeholders(products: DataFrame, other: DataFrame, key: str = "csc") -> DataFrame:
    """All listed keys plus placeholder rows for keys only the other source has."""
    extra = other.select(key).distinct().join(products.select(key), key, "left_anti")
    return products.select(key, "name", F.lit(True).alias("listed")).unionByName(
        extra.select(key, F.concat(F.lit("Item "), F.col(key)).alias("name"), F.lit(False).alias("listed"))
    )
