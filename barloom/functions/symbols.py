"""Symbol spelling: one canonical form, the market it tells, and the dialects of sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The canonical spellings.
A_SHARE = r"^[0-9]{6}\.(SH|SZ|BJ)$"
HK = r"^[0-9]{4,5}\.HK$"
US = r"^[A-Z.]+\.(US|NY|NQ)$"
CRYPTO = r"^[A-Z0-9]+-[A-Z0-9]+$"


def _like(x: Column, pattern: str) -> Column:
    return F.rlike(x, F.lit(pattern))


def normalise_symbol(raw: Column) -> Column:
    """Trimmed, unquoted and upper-cased; an exchange in front goes behind, a bare code gets its exchange."""
    s = F.upper(F.btrim(F.btrim(F.trim(raw), F.lit('"')), F.lit("'")))
    code = F.regexp_extract(s, r"^(.*)\.", 1)
    board = F.when(_like(s, "^(92|4|8)"), ".BJ").when(_like(s, "^[03]"), ".SZ").otherwise(".SH")
    return (
        F.when(_like(s, CRYPTO), s)
        .when(_like(s, "^(SH|SZ|BJ)[0-9]{6}$"), F.concat(F.substring(s, 3, 6), F.lit("."), F.substring(s, 1, 2)))
        .when(_like(s, r"^[0-9]{1,4}\.HK$"), F.concat(F.lpad(code, 5, "0"), F.lit(".HK")))
        .when(F.contains(s, F.lit(".")), s)
        .when(_like(s, "^[0-9]{6}$"), F.concat(s, board))
        .when(_like(s, "^[0-9]{1,5}$"), F.concat(F.lpad(s, 5, "0"), F.lit(".HK")))
        .when(_like(s, r"^[A-Z][A-Z-]{0,6}$"), F.concat(s, F.lit(".US")))
        .otherwise(s)
    )


def market_of(symbol: Column) -> Column:
    """A, HK, US or CRYPTO of a canonical symbol; null for any other."""
    return F.when(_like(symbol, A_SHARE), "A").when(_like(symbol, HK), "HK").when(_like(symbol, US), "US").when(_like(symbol, CRYPTO), "CRYPTO")


def bare_code(symbol: Column) -> Column:
    return F.substring_index(symbol, ".", 1)


def exchange(symbol: Column) -> Column:
    return F.substring_index(symbol, ".", -1)


def dotted_lower(symbol: Column) -> Column:
    """``sh.600000``."""
    return F.concat(F.lower(exchange(symbol)), F.lit("."), bare_code(symbol))


def glued_lower(symbol: Column) -> Column:
    """``sh600000``."""
    return F.concat(F.lower(exchange(symbol)), bare_code(symbol))


def yahoo_style(symbol: Column) -> Column:
    """``600000.SS``, ``0700.HK``, ``AAPL``, ``BTC-USD``."""
    market = market_of(symbol)
    quote = F.substring_index(symbol, "-", -1)
    fiat = F.when(quote.isin("USDT", "USDC", "BUSD"), "USD").otherwise(quote)
    return (
        F.when(market == "A", F.concat(bare_code(symbol), F.lit("."), F.when(exchange(symbol) == "SH", "SS").otherwise(exchange(symbol))))
        .when(market == "HK", F.concat(F.lpad(F.ltrim(bare_code(symbol), F.lit("0")), 4, "0"), F.lit(".HK")))
        .when(market == "US", bare_code(symbol))
        .when(market == "CRYPTO", F.concat(F.substring_index(symbol, "-", 1), F.lit("-"), fiat))
    )
