"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What bank statements call payments, issuers and transfers.
PAYMENT_WORD = r"(?i)\b(PAYMENT|PAYMENTS|PYMT|PMT|AUTOPAY|AUTO PAY|E-?PAY|E-?PAYMENT|BILL ?PAY|ONLINE PMT|\bACH\b)\b"
CARD_ISSUER = r"(?i)\b(AMEX|AMERICAN EXPRESS|CHASE CARD|CHASE CREDIT|CAPITAL ONE|DISCOVER|CITI CARD|CITIBANK|SYNCHRONY|BARCLAY|COMENITY|CREDIT CRD|BANK OF AMERICA|WELLS FARGO)\b"
STANDALONE_PAYMENT = r"(?i)\b(CARD PAYMENT|CARD PMT|CC ?PYMT|CREDIT CARD PAYMENT|CARDMEMBER SERV|CARDMEMBER PAYMENT|EPAYMENT)\b"
TRANSFER = r"(?i)ONLINE BANKING TRANSFER|\bTRANSFER\s+(TO|FROM)\b"
CARD_WORD = r"(?i)\b(VISA|MASTERCARD|MASTER CARD|AMEX|AMERICAN EXPRESS|DISCOVER|CREDIT CARD|CREDIT CRD|CARD PAYMENT|CARD PMT|CC PYMT|CARDMEMBER)\b"
CARD_CREDIT_NOT_REFUND = (
    r"(?i)\b(?:PAYMENTS?|PYMT|PYMNT|PMT|AUTOPAY|AUTO ?PAY|DIRECTPAY|BILL ?PAY|CASH ?BACK|CASHBACK|REWARDS?|REDEMPTION|REDEEM|STATEMENT CREDIT"
    r"|BALANCE TRANSFER|INTEREST REFUND|FEE REFUND|FEE REVERSAL|CREDIT ADJUSTMENT)\b"
)
MASKED = r"^[\s*·.xX_-]+$"
STOP_WORDS = [
    "POS", "PURCHASE", "PAYMENT", "PAYMENTS", "DEBIT", "CREDIT", "CARD", "ACH", "PENDING", "RECURRING", "ONLINE", "MOBILE", "TRANSACTION", "TRANSFER", "THE", "AND", "FROM", "WWW", "COM",
    "HTTP", "HTTPS", "INC", "LLC", "USA", "US", "ATM", "WITHDRAWAL", "WITHDRAWALS", "DEPOSIT", "DEPOSITS", "CHECK", "CHECKS", "BILL", "BILLPAY", "AUTOPAY", "WITHDRAW",
]


def present(c: Column) -> Column:
    """Null for an empty text: both count as absent."""
    return F.nullif(c, F.lit(""))


def matches(c: Column, pattern: str) -> Column:
    """Whether a text matches; a null does not."""
    return F.coalesce(c.rlike(pattern), F.lit(False))


def is_card_payment_text(c: Column) -> Column:
    """Wording of a payment to a card, as the paying side's bank writes it."""
    return matches(c, STANDALONE_PAYMENT) | (matches(c, CARD_ISSUER) & matches(c, PAYMENT_WORD)) | (matches(c, TRANSFER) & matches(c, CARD_WORD))


def is_card_payment_received(c: Column) -> Column:
    """Wording of a credit on a card that is no refund."""
    return matches(c, CARD_CREDIT_NOT_REFUND)


def merchant_key(c: Column) -> Column:
    """Upper-case alphanumeric tokens without those of digits only."""
    tokens = F.split(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", " "), " ")
    return F.array_join(F.filter(tokens, lambda t: (t != "") & ~t.rlike("^[0-9]+$")), " ")


def normal_merchant(c: Column) -> Column:
    """Upper-case letters and single spaces."""
    up = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[0-9#*]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(up, "[^A-Z ]+", " "), r"\s+", " "))


def normal_description(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""), r"\s+", " "))


def description_tokens(c: Column) -> Column:
    tokens = F.split(F.regexp_replace(normal_description(c), "[^A-Z0-9 ]", " "), r"\s+")
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$") & ~F.array_contains(stop, t)))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard of two token arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def csv_cell(c: Column) -> Column:
    """A quoted CSV cell that no spreadsheet takes for a formula."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    text = F.when(text.rlike(r"^[=+@\t]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
