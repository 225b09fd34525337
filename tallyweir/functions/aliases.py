"""Concept aliases and other small reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Alias -> concepts in order of precedence, as taxonomy:tag:unit; without a unit any is taken.
ALIASES: dict[str, tuple[str, ...]] = {
    "accounts_payable": ("us-gaap:AccountsPayableCurrent:USD",),
    "accounts_receivable": ("us-gaap:AccountsReceivableNetCurrent:USD", "us-gaap:ReceivablesNetCurrent:USD"),
    "accrued_liabilities": ("us-gaap:AccruedLiabilitiesCurrent:USD",),
    "amortization_intangibles": ("us-gaap:AmortizationOfIntangibleAssets:USD",),
    "assets": ("us-gaap:Assets:USD", "ifrs-full:Assets:"),
    "assets_current": ("us-gaap:AssetsCurrent:USD", "ifrs-full:CurrentAssets:"),
    "capex": (
        "us-gaap:PaymentsToAcquirePropertyPlantAndEquipment:USD", "us-gaap:PaymentsToAcquireProductiveAssets:USD",
        "ifrs-full:PurchaseOfPropertyPlantAndEquipmentClassifiedAsInvestingActivities:",
    ),
    "cash": ("us-gaap:CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents:USD", "us-gaap:CashAndCashEquivalentsAtCarryingValue:USD", "ifrs-full:CashAndCashEquivalents:"),
    "cogs": ("us-gaap:CostOfGoodsAndServicesSold:USD", "us-gaap:CostOfRevenue:USD", "us-gaap:CostOfGoodsSold:USD", "ifrs-full:CostOfSales:"),
    "debt": ("us-gaap:LongTermDebtNoncurrent:USD", "us-gaap:LongTermDebtAndFinanceLeaseObligationsNoncurrent:USD", "ifrs-full:LongtermBorrowings:"),
    "deferred_revenue": ("us-gaap:ContractWithCustomerLiability:USD", "us-gaap:DeferredRevenue:USD", "us-gaap:DeferredRevenueCurrent:USD"),
    "deferred_tax_assets": ("us-gaap:DeferredTaxAssetsNet:USD", "us-gaap:DeferredTaxAssetsLiabilitiesNet:USD"),
    "deferred_tax_liabilities": ("us-gaap:DeferredIncomeTaxLiabilitiesNet:USD",),
    "depreciation": ("us-gaap:Depreciation:USD", "us-gaap:DepreciationAndAmortization:USD"),
    "diluted_eps": ("us-gaap:EarningsPerShareDiluted:USD/shares", "ifrs-full:DilutedEarningsLossPerShare:"),
    "dividends_paid": ("us-gaap:PaymentsOfDividends:USD", "us-gaap:PaymentsOfDividendsCommonStock:USD"),
    "dna": (
        "us-gaap:DepreciationDepletionAndAmortization:USD", "us-gaap:DepreciationAndAmortization:USD", "us-gaap:Depreciation:USD",
        "ifrs-full:AdjustmentsForDepreciationAndAmortisationExpense:",
    ),
    "eps": ("us-gaap:EarningsPerShareDiluted:USD/shares", "ifrs-full:DilutedEarningsLossPerShare:"),
    "equity": ("us-gaap:StockholdersEquity:USD", "us-gaap:StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest:USD", "ifrs-full:Equity:"),
    "financing_cash_flow": ("us-gaap:NetCashProvidedByUsedInFinancingActivities:USD", "ifrs-full:CashFlowsFromUsedInFinancingActivities:"),
    "goodwill": ("us-gaap:Goodwill:USD", "ifrs-full:Goodwill:"),
    "gross_profit": ("us-gaap:GrossProfit:USD", "ifrs-full:GrossProfit:"),
    "income_tax_expense": ("us-gaap:IncomeTaxExpenseBenefit:USD",),
    "intangibles": ("us-gaap:IntangibleAssetsNetExcludingGoodwill:USD", "us-gaap:FiniteLivedIntangibleAssetsNet:USD", "ifrs-full:IntangibleAssetsOtherThanGoodwill:"),
    "interest_expense": ("us-gaap:InterestExpense:USD",),
    "inventory": ("us-gaap:InventoryNet:USD", "ifrs-full:Inventories:"),
    "investing_cash_flow": ("us-gaap:NetCashProvidedByUsedInInvestingActivities:USD", "ifrs-full:CashFlowsFromUsedInInvestingActivities:"),
    "liabilities": ("us-gaap:Liabilities:USD", "ifrs-full:Liabilities:"),
    "liabilities_current": ("us-gaap:LiabilitiesCurrent:USD", "ifrs-full:CurrentLiabilities:"),
    "net_income": ("us-gaap:NetIncomeLoss:USD", "ifrs-full:ProfitLoss:"),
    "operating_cash_flow": ("us-gaap:NetCashProvidedByUsedInOperatingActivities:USD", "ifrs-full:CashFlowsFromUsedInOperatingActivities:"),
    "operating_income": ("us-gaap:OperatingIncomeLoss:USD", "ifrs-full:ProfitLossFromOperatingActivities:"),
    "operating_lease_liabilities": ("us-gaap:OperatingLeaseLiability:USD", "us-gaap:OperatingLeaseLiabilityNoncurrent:USD"),
    "operating_lease_rou_assets": ("us-gaap:OperatingLeaseRightOfUseAsset:USD",),
    "retained_earnings": ("us-gaap:RetainedEarningsAccumulatedDeficit:USD",),
    "revenue": (
        "us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax:USD", "us-gaap:Revenues:USD", "us-gaap:RevenueFromContractWithCustomerIncludingAssessedTax:USD",
        "us-gaap:SalesRevenueNet:USD", "us-gaap:SalesRevenueGoodsNet:USD", "us-gaap:SalesRevenueServicesNet:USD", "ifrs-full:Revenue:",
    ),
    "share_repurchases": ("us-gaap:PaymentsForRepurchaseOfCommonStock:USD",),
    "shares": ("dei:EntityCommonStockSharesOutstanding:shares", "ifrs-full:NumberOfSharesOutstanding:shares"),
    "shares_outstanding": ("dei:EntityCommonStockSharesOutstanding:shares", "us-gaap:CommonStockSharesOutstanding:shares", "ifrs-full:NumberOfSharesOutstanding:shares"),
    "short_term_debt": ("us-gaap:LongTermDebtCurrent:USD", "us-gaap:DebtCurrent:USD", "us-gaap:ShortTermBorrowings:USD", "ifrs-full:CurrentBorrowingsAndCurrentPortionOfNoncurrentBorrowings:"),
    "stock_compensation": ("us-gaap:ShareBasedCompensation:USD", "us-gaap:StockBasedCompensation:USD"),
}

# Metric bundles.
BUNDLES: dict[str, tuple[str, ...]] = {
    "income-statement": ("revenue", "cogs", "gross_profit", "operating_income", "net_income", "eps", "diluted_eps"),
    "balance-sheet": ("assets", "liabilities", "equity", "cash", "debt", "short_term_debt", "assets_current", "liabilities_current"),
    "cash-flow": ("operating_cash_flow", "capex"),
    "liquidity": ("assets_current", "liabilities_current", "cash"),
    "capital-structure": ("debt", "short_term_debt", "equity", "cash", "shares"),
    "quality": ("net_income", "operating_cash_flow", "assets_current", "liabilities_current"),
}

# Form classes.
FORM_CLASSES: dict[str, tuple[str, ...]] = {
    "major": ("10-K", "10-K/A", "10-Q", "10-Q/A", "20-F", "20-F/A", "40-F", "6-K", "8-K", "8-K/A", "DEF 14A", "S-1", "S-1/A"),
    "insider": ("144", "3", "3/A", "4", "4/A", "5", "5/A"),
    "institutional": ("13F-HR", "13F-HR/A", "13F-NT", "SC 13D", "SC 13D/A", "SC 13G", "SC 13G/A", "SCHEDULE 13D", "SCHEDULE 13D/A", "SCHEDULE 13G", "SCHEDULE 13G/A"),
}
PERIODIC_FORMS = ("10-K", "10-K/A", "10-Q", "10-Q/A", "20-F", "20-F/A", "40-F", "40-F/A")


def candidates() -> list[tuple[str, int, str, str, str]]:
    """(alias, precedence, taxonomy, tag key, unit key) of all aliases."""
    return [(a, i, *c.lower().split(":")) for a, concepts in ALIASES.items() for i, c in enumerate(concepts)]


def alias_table(spark: SparkSession) -> DataFrame:
    """The aliases as a table of fixed size, to be broadcast."""
    return spark.createDataFrame(candidates(), "alias string, precedence int, taxonomy string, tag string, unit string")


def alias_values_sql() -> str:
    """The same table as a VALUES list."""
    return ", ".join(f"('{a}', {p}, '{x}', '{t}', '{u}')" for a, p, x, t, u in candidates())


def alias_key(text: Column) -> Column:
    """'Net-Income ' and 'net income' are 'net_income'."""
    return F.translate(F.lower(F.trim(text)), "- ", "__")
