"""Bank-feed JSON: accounts and transactions, normalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches, present

#: The envelope in both versions of the protocol: messages are texts in ``errors`` or objects in ``errlist``, and banks stand with the account or in ``connections``.
ACCOUNTS = (
    "errors array<string>, errlist array<struct<code:string, msg:string, message:string, conn_id:string, account_id:string>>, connections array<struct<conn_id:string, name:string, org_id:string, org_name:string, org_url:string>>,"
    " accounts array<struct<conn_id:string, id:string, name:string, currency:string, balance:string, `available-balance`:string, `balance-date`:long, org:struct<id:string, name:string, domain:string, url:string>,"
    " transactions:array<struct<id:string, posted:long, transacted_at:long, amount:string, description:string, payee:string, memo:string, pending:boolean>>>>"
)
# Account types by name, first match first; and issuers of cards only.
TYPE_RULES = [
    (r"(?i)\b(brokerage|invest|investment|401\s?k|403\s?b|\bira\b|roth|hsa|portfolio|securities|mutual fund)\b", "investment", "brokerage"),
    (r"(?i)\b(mortgage|home loan|auto loan|car loan|student loan|personal loan|loan|heloc|line of credit|lending)\b", "loan", "loan"),
    (r"(?i)\b(savings|saver|save|money market|\bmma\b|certificate|\bcd\b|holiday|christmas club|emergency fund|share savings)\b", "depository", "savings"),
    (r"(?i)\b(checking|chequing|share draft|debit|spending|current account)\b", "depository", "checking"),
    (r"(?i)\b(credit card|visa|mastercard|master card|amex|american express|discover card|rewards card|cash ?back|\bcredit\b|\bcard\b)\b", "credit", "credit card"),
    (r"(?i)\b(venture|quicksilver|savor(one)?|spark|freedom|sapphire|slate|\bink\b|reserve|preferred|unlimited|double cash|active cash|custom cash|altitude|propel|bonvoy|skymiles|aadvantage|rapid rewards|hyatt|platinum|signature|gold)\b", "credit", "credit card"),
]
CARD_ONLY = r"(?i)\b(american express|amex|discover|barclaycard|barclays|synchrony|comenity|credit one|first premier|bread financial)\b"
# Wording of a bank's trouble and of notes about the range that was asked for; codes of such notes.
ADVISORY_CODES, CAPPED_CODES = ["DATE_RANGE_EXCEEDED", "DATE_RANGE_RECOMMENDED"], ["DATE_RANGE_CAPPED", "DATE_RANGE_TRUNCATED"]
TROUBLE = (
    r"(?i)\b(reconnect|authenticat\w*|credential\w*|password|login|logged\s+out|need(s|ed)?\s+attention|payment\s+required|subscription|expired|revoked|denied|mfa|multi-?factor|forbidden|unauthoriz\w*|locked"
    r"|suspend\w*|invalid|rate\s+limit|try\s+again|unavailable|timed?\s*out|error|fail\w*|unable\s+to)\b"
)
RANGE_SUBJECT = r"(?i)\bdate range\b|\brange requested\b|\brequested\s+(date\s+)?range\b"
RANGE_LIMIT = r"(?i)\b(exceed|exceeds|exceeded|limit|maximum|recommended|cap|capped)\b"
WAS_CAPPED, FUTURE_CAP = r"(?i)\b(was|were|been)\s+capped\b", r"(?i)\b(may|might|could|will|can|would|shall)\s+be\s+capped\b"


def account_type(name: Column, org: Column, balance: Column) -> Column:
    """type, subtype and uncertain, by the account's and its bank's name, then by the sign of the balance."""
    said = F.concat_ws(" ", name, org)
    kind = lambda t, s, u: F.struct(F.lit(t).alias("type"), F.lit(s).alias("subtype"), F.lit(u).alias("uncertain"))
    out = F.when(F.lit(False), kind("", "", False))
    for pattern, t, s in TYPE_RULES:
        out = out.when(matches(said, pattern), kind(t, s, False))
    return out.when(matches(org, CARD_ONLY), kind("credit", "credit card", False)).when(balance < 0, kind("credit", "credit card", True)).otherwise(kind("depository", "checking", True))


def stored_balance(kind: Column, balance: Column) -> Column:
    """Debts are stored as what is owed."""
    return F.when(kind.isin("credit", "loan"), F.abs(balance)).otherwise(balance)


def message_kind(text: Column, code: Column | None = None, per_bank: Column | None = None) -> Column:
    """error, advisory or capped.

    Words of trouble make an error of anything; then a known code decides; what is pinned to one bank or account is its
    error; else the wording tells.
    """
    ranged = matches(text, RANGE_SUBJECT) & matches(text, RANGE_LIMIT)
    has = lambda p: matches(text, p)
    key = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(code, F.lit(""))), "[^A-Z0-9]+", "_"), "^_+|_+$", "") if code is not None else F.lit("")
    pinned = F.coalesce(per_bank, F.lit(False)) if per_bank is not None else F.lit(False)
    return (
        F.when(has(TROUBLE), "error").when(key.isin(CAPPED_CODES), "capped").when(key.isin(ADVISORY_CODES), "advisory").when(pinned | ~ranged, "error").when(has(WAS_CAPPED), "capped")
        .when(has(r"(?i)\bcapped\b") & ~has(FUTURE_CAP), "capped").when(has(r"(?i)\brecommended\b"), "advisory").when(has(r"(?i)\b(limit|maximum)\b"), "capped").otherwise("advisory")
    )


def clean_message(text: Column) -> Column:
    """No control characters or tags, single spaces, 300 characters."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1F\x7F]+", " "), "<[^>]*>", " ")
    return F.substring(F.trim(F.regexp_replace(plain, r"\s+", " ")), 1, 300)


def feed_messages(feeds: DataFrame) -> DataFrame:
    """household_id, message and kind of every message of both versions; those without a text or a code are left out."""
    none = F.lit(None).cast("string")
    plain = F.transform("feed.errors", lambda e: F.struct(clean_message(e).alias("msg"), F.lit("").alias("code"), F.lit(False).alias("per_bank")))
    told = lambda e: clean_message(F.coalesce(present(e["msg"]), present(e["message"]), none))
    listed = F.transform("feed.errlist", lambda e: F.struct(told(e).alias("msg"), clean_message(e["code"]).alias("code"), (present(e["conn_id"]).isNotNull() | present(e["account_id"]).isNotNull()).alias("per_bank")))
    empty = F.array().cast("array<struct<msg:string,code:string,per_bank:boolean>>")
    rows = feeds.select("household_id", F.inline(F.concat(F.coalesce(plain, empty), F.coalesce(listed, empty))))
    rows = rows.withColumn("message", F.when((F.col("msg") != "") & (F.col("code") != ""), F.concat("msg", F.lit(" ("), "code", F.lit(")"))).otherwise(F.concat("msg", "code"))).where("message != ''")
    return rows.select("household_id", "message", message_kind(F.col("message"), F.col("code"), F.col("per_bank")).alias("kind"))


def parsed(raw: DataFrame, column: str = "json") -> DataFrame:
    """``raw`` with the feed's envelope as ``feed``; what isn't JSON is null."""
    return raw.withColumn("feed", F.from_json(column, ACCOUNTS))


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-z]+://([^/:?#]+)", 1))


def _bank(a: Column, connections: Column) -> Column:
    """id, name, domain and url of an account's bank: its own, or that of the connection it names (never by the connection's id, which tells no bank)."""
    mine = F.get(F.filter(connections, lambda c: c["conn_id"] == a["conn_id"]), F.lit(0))
    joined = F.struct(mine["org_id"].alias("id"), F.coalesce(present(mine["org_name"]), mine["name"]).alias("name"), _host(mine["org_url"]).alias("domain"), mine["org_url"].alias("url"))
    return F.coalesce(a["org"], F.when(mine.isNotNull(), joined))


def _all(items: Column) -> Column:
    """Each of ``items``, none if null.  Of a plain column that is exploded Spark asks first whether it is empty, and where it is read from JSON that reads it again."""
    return F.transform(items, lambda i: i)


def _org(org: Column) -> Column:
    return F.coalesce(present(org["id"]), present(F.lower(org["domain"])), present(_host(org["url"])), present(org["name"]))


def resolve_institutions(held: DataFrame, orgs: DataFrame) -> DataFrame:
    """household_id, org_key, institution_id and fresh (to be inserted) of the banks of a pull; those that are held as disabled are left out.

    held: household_id, org_key, institution_id, disabled; orgs: household_id, org_key.
    """
    both = orgs.where("org_key is not null").select("household_id", "org_key").distinct().join(held.select("household_id", "org_key", "institution_id", "disabled"), ["household_id", "org_key"], "left")
    return both.where(~F.coalesce("disabled", F.lit(False))).select("household_id", "org_key", "institution_id", F.col("institution_id").isNull().alias("fresh"))


def feed_accounts(feeds: DataFrame, *keep: str) -> DataFrame:
    """A row per account of household_id and feed.  keep: other columns of ``feeds`` to go with it, and its place in the feed (nth)."""
    a = F.col("a")
    rows = feeds.select("household_id", *keep, "feed.connections", F.posexplode("feed.accounts").alias("nth", "a")).withColumn("org", _bank(a, F.col("connections")))
    org = F.col("org")
    balance = a["balance"].try_cast("decimal(14,2)")
    more = [*keep, "nth", "currency", "raw_balance"] if keep else []
    rows = rows.select("household_id", *keep, "nth", a["currency"].alias("currency"), a["id"].alias("external_id"), a["name"].alias("name"), _org(org).alias("org_key"), account_type(a["name"], org["name"], balance).alias("k"), balance.alias("raw_balance"), a["balance-date"].alias("at")).where("external_id is not null and trim(external_id) != ''")
    return rows.select("household_id", "external_id", "name", "org_key", "k.type", "k.subtype", "k.uncertain", stored_balance(F.col("k.type"), F.col("raw_balance")).alias("balance"), F.when(F.col("at") > 0, F.timestamp_seconds("at").cast("date")).alias("balance_on"), *more)


def feed_transactions(feeds: DataFrame, *keep: str) -> DataFrame:
    """A row per transaction that has an id, an amount and a date; money out is positive here and negative in the feed.

    keep: other columns of ``feeds`` to go with it, and its place in the feed (nth).
    """
    rows = feeds.select("household_id", *keep, F.posexplode(_all(F.col("feed.accounts"))).alias("m", "a")).select("household_id", *keep, "m", F.col("a.id").alias("account"), F.posexplode(_all(F.col("a.transactions"))).alias("n", "t"))
    place = [*keep, F.struct("m", "n").alias("nth")] if keep else []
    when = F.coalesce(*(F.when(F.col(f"t.{c}") > 0, F.timestamp_seconds(F.col(f"t.{c}")).cast("date")) for c in ("posted", "transacted_at")))
    out = rows.select(
        "household_id", "account", F.trim("t.id").alias("external_id"), when.alias("date"), (-F.col("t.amount").try_cast("decimal(14,2)")).alias("amount"),
        F.coalesce(present(F.col("t.description")), present(F.col("t.payee")), present(F.col("t.memo")), F.lit("")).alias("description"), F.coalesce("t.payee", F.lit("")).alias("merchant_name"), F.coalesce("t.pending", F.lit(False)).alias("pending"), *place,
    )
    return out.where("external_id != '' and amount is not null and date is not null")


def account_sets(feeds: DataFrame) -> DataFrame:
    """What each household's envelopes hold, in one pass: usable accounts (with an id), skipped ones, and transactions that can and can't be read."""
    usable = lambda a: F.length(F.trim(F.coalesce(a["id"], F.lit("")))) > 0
    accounts = F.filter("feed.accounts", lambda a: a.isNotNull())
    rows = F.flatten(F.transform(F.filter(accounts, lambda a: usable(a) & a["transactions"].isNotNull()), lambda a: a["transactions"]))
    readable = F.size(F.filter(rows, lambda t: (F.trim(t["id"]) != "") & t["amount"].try_cast("decimal(14,2)").isNotNull() & ((t["posted"] > 0) | (t["transacted_at"] > 0))))
    n = lambda c: F.sum(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))).cast("long")
    return feeds.groupBy("household_id").agg(n(F.size(F.filter(accounts, usable))).alias("usable"), n(F.size(F.filter(accounts, lambda a: ~usable(a)))).alias("skipped"), n(readable).alias("readable"), n(F.size(rows) - readable).alias("unreadable"))


def window_start(last_pulled: Column, now: str, overlap: int = 30, floor: int = 730, reach: int = 88) -> Column:
    """First day to ask a feed for: a month before the last pull, within two years, within what the feed serves."""
    today = F.lit(now).cast("date")
    wanted = F.greatest(F.coalesce(F.date_sub(last_pulled, overlap), F.date_sub(today, floor)), F.date_sub(today, floor))
    return F.greatest(wanted, F.date_sub(today, reach))
