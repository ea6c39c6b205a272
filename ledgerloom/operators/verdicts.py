"""What a transaction is: spending, income, a card payment, a transfer; its category and type.

All are Column expressions over one row: amount (positive is money out), account_type, description, merchant_name,
mapped_category, user_category, user_type, excluded, and internal where pairs have been marked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MASKED, is_card_payment_received, is_card_payment_text, matches, present

TRANSFER_CATEGORY, RETURN_CATEGORY, UNCATEGORIZED = "Transfers and card payments", "Return", "Uncategorized"
MECHANISMS = [TRANSFER_CATEGORY, RETURN_CATEGORY, UNCATEGORIZED]
TYPES = ["spending", "inflow", "transfer", "card_payment"]

_c = F.col


def _yes(name: str) -> Column:
    return F.coalesce(_c(name), F.lit(False))


def effective_category() -> Column:
    return F.coalesce(present(_c("user_category")), present(_c("mapped_category")), F.lit(UNCATEGORIZED))


def bank_name() -> Column:
    plain = [F.when(~matches(_c(n), MASKED), present(_c(n))) for n in ("merchant_name", "description")]
    return F.coalesce(*plain, F.lit("Card transaction"))


def display_name() -> Column:
    return F.coalesce(present(_c("user_description")), bank_name())


def is_loan() -> Column:
    return _c("account_type").eqNullSafe(F.lit("loan"))


def is_card() -> Column:
    return _c("account_type").eqNullSafe(F.lit("credit"))


def is_worded_payment() -> Column:
    """Whether either text is worded as a payment to a card: many patterns, so it is computed once a row (see ``with_verdicts``)."""
    return is_card_payment_text(_c("description")) | is_card_payment_text(_c("merchant_name"))


def is_card_payment(worded: Column | None = None) -> Column:
    """A user's category decides; on a card only credits can be, by their wording; elsewhere the payer's wording tells."""
    user = present(_c("user_category"))
    received = is_card_payment_received(_c("description")) | is_card_payment_received(_c("merchant_name"))
    return (
        F.when(user.isNotNull(), user == TRANSFER_CATEGORY)
        .when(is_card(), (_c("amount") < 0) & received)
        .otherwise(is_worded_payment() if worded is None else worded)
    )


def _barred() -> Column:
    return _yes("excluded") | _yes("internal") | is_loan() | (F.coalesce(_c("amount"), F.lit(0)) == 0)


def is_spend(card_payment: Column | None = None) -> Column:
    """Money out that isn't a card payment, or a refund on a card; a user's type overrides."""
    user = present(_c("user_type"))
    paid = is_card_payment() if card_payment is None else card_payment
    return (
        F.when(_barred(), False)
        .when(user.isNotNull(), user == "spending")
        .when(_c("amount") < 0, is_card() & ~paid)
        .otherwise(~paid)
    )


def is_income() -> Column:
    """Money into a depository account; a user's type overrides."""
    user = present(_c("user_type"))
    return F.when(_barred() | present(_c("account_type")).isNull(), False).when(user.isNotNull(), user == "inflow").otherwise((_c("account_type") == "depository") & (_c("amount") < 0))


def derived_type(worded: Column | None = None, card_payment: Column | None = None) -> Column:
    worded = is_worded_payment() if worded is None else worded
    paid = F.when(is_card_payment() if card_payment is None else card_payment, "card_payment").otherwise("spending")
    return (
        F.when(is_loan(), "loan")
        .when(_yes("internal"), F.when(is_card() | worded, "card_payment").otherwise("transfer"))
        .when((_c("amount") > 0) | is_card(), paid)
        .otherwise("inflow")
    )


def effective_type(derived: Column | None = None) -> Column:
    return F.when(is_loan(), "loan").when(_c("user_type").isin(TYPES), _c("user_type")).otherwise(derived_type() if derived is None else derived)


def display_category(kind: Column | None = None) -> Column:
    return F.when((effective_type() if kind is None else kind).isin("transfer", "card_payment"), TRANSFER_CATEGORY).otherwise(effective_category())


def type_label(kind: Column, amount: Column) -> Column:
    """A label for a type; spending that comes in is a refund."""
    return (
        F.when((kind == "spending") & (amount < 0), "Refund").when(kind == "spending", "Spending").when(kind == "inflow", "Income")
        .when(kind == "transfer", "Transfer").when(kind == "card_payment", "Card payment").when(kind == "loan", "Loan")
    )


def _judged(rows: DataFrame) -> DataFrame:
    """``rows`` with the verdicts that others rest on, each computed once: _worded, _card, _auto and _type.  internal is false where it is missing."""
    if "internal" not in rows.columns:
        rows = rows.withColumn("internal", F.lit(False))
    rows = rows.withColumn("_worded", is_worded_payment()).withColumn("_card", is_card_payment(_c("_worded")))
    return rows.withColumn("_auto", derived_type(_c("_worded"), _c("_card"))).withColumn("_type", effective_type(_c("_auto")))


def with_verdicts(rows: DataFrame) -> DataFrame:
    """``rows`` with category, counted, income, card_payment, auto_type and type.  internal is false where it is missing."""
    judged = _judged(rows)
    own = [c for c in judged.columns if c not in ("_worded", "_card", "_auto", "_type")]
    return judged.select(*own, effective_category().alias("category"), is_spend(_c("_card")).alias("counted"), is_income().alias("income"), _c("_card").alias("card_payment"), _c("_auto").alias("auto_type"), _c("_type").alias("type"))


def shape(rows: DataFrame) -> DataFrame:
    """The presentation row of each transaction."""
    return _judged(rows).select(
        "household_id", "id", "account_id", display_name().alias("merchant_name"), "description", _c("date").alias("transaction_date"), "amount", display_category(_c("_type")).alias("category"),
        F.coalesce(present(_c("mapped_category")), F.lit(UNCATEGORIZED)).alias("auto_category"), bank_name().alias("auto_description"), present(_c("user_category")).alias("user_category"),
        present(_c("user_description")).alias("user_description"), _yes("excluded").alias("excluded"), "user_type", _c("_auto").alias("auto_tx_type"), _c("_type").alias("tx_type"),
        "entity_id", _yes("is_capital").alias("is_capital"), "placed_in_service", "useful_life_years", is_spend(_c("_card")).alias("counted"),
    )
