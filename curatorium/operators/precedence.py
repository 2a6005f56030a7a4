"""Which side wins, field by field, when an extraction is merged into a stored record, and why.

A table says for each field whether a feed's record locks it and what its values are; each kind of value has a test for a new one to be usable and one for a
stored one to stay. The table compiles to one expression a field, and the reasons come as a map.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatorium.functions import lexicon
from curatorium.operators import rules
from curatorium.operators.relations import LOCKED

FEED = "jgrants"
KINDS = {
    **dict.fromkeys(("application_period", "application_period_text"), "period"), **dict.fromkeys(("region", "region_text", "prefecture"), "region"), **dict.fromkeys(("official_url", "source_url"), "address"),
    **dict.fromkeys(("amount_text", "max_amount", "amount_max_yen"), "amount"), **dict.fromkeys(("subsidy_rate_text", "subsidy_rate"), "rate"), **dict.fromkeys(("target_expenses_arr", "target_entities_arr", "purposes", "industries", "tags"), "list"),
}
#: Fields whose values are dropped before a merge where they cannot be what they are sent as.
CHECKED = ("application_period", "application_period_text", "region", "region_text", "official_url")
TAKEN, FILLED = "taken", "taken: the locked field was empty"
NO_VALUE, IS_LOCKED, UNUSABLE, STAYS, NATIONAL, LIST = "kept: no new value", "kept: locked", "kept: new value unusable", "kept: stored value holds", "kept: national", "kept: new list empty"


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def valid_period(c: Column) -> Column:
    """A text that gives dates or says that there are none, and is no title."""
    t = _text(c)
    dated = t.rlike(lexicon.DATED)
    title = (F.length(t) >= 20) & t.rlike(lexicon.TITLE_LIKE) & ~dated
    return (t != "") & ~title & (t.rlike(lexicon.UNDATED_PERIOD) | dated)


def valid_region(c: Column) -> Column:
    t = _text(c)
    return (F.length(t) <= 40) & t.rlike(lexicon.KNOWN_REGION)


def valid_address(c: Column) -> Column:
    return _text(c).rlike("(?i)^https?://.+")


def concrete_amount(c: Column) -> Column:
    t = _text(c)
    return ~t.isin(list(lexicon.NO_AMOUNT)) & t.rlike("[0-9０-９]|上限|最大|限度額")


def concrete_rate(c: Column) -> Column:
    t = _text(c)
    return ~t.isin(list(lexicon.NO_AMOUNT)) & ~t.rlike(lexicon.REFERENCE_ONLY) & t.rlike(lexicon.CONCRETE_RATE)


_USABLE = {"period": valid_period, "region": valid_region, "address": valid_address}
_STAYS = _USABLE | {"amount": concrete_amount, "rate": concrete_rate}


def reason(name: str, old: Column, new: Column, feed: Column) -> Column:
    """Why a field is kept or taken; the first that applies. feed: whether the stored record is a feed's."""
    kind = KINDS.get(name)
    if kind == "list":
        some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
        return rules.decision([(new.isNull(), NO_VALUE), (some(old) & ~some(new), LIST)], TAKEN)
    steps = [(_text(new) == "", NO_VALUE)]
    if name in LOCKED:
        steps += [(feed & (_text(old) != ""), IS_LOCKED), (feed, FILLED)]
    if kind in _USABLE:
        steps.append((~_USABLE[kind](new), UNUSABLE))
    if name == "prefecture":
        steps.append((feed & (_text(old) == "全国") & F.contains(_text(new), F.lit("愛媛")), NATIONAL))
    if kind in _STAYS:
        steps.append((_STAYS[kind](old), STAYS))
    return rules.decision(steps, TAKEN)


def merged(current: dict[str, Column], found: dict[str, Column], source_type: Column) -> dict[str, Column]:
    """The merged fields, those that only the extraction has included, and `why`: a map from each field that the extraction knows to the reason."""
    feed = F.coalesce(_text(source_type) == FEED, F.lit(False))
    out, why = dict(current), []
    for name, new in found.items():
        old = current.get(name, F.lit(None).cast("array<string>" if KINDS.get(name) == "list" else "string"))
        told = reason(name, old, new, feed)
        out[name] = F.when(told.startswith("taken"), new).otherwise(old)
        why += [F.lit(name), told]
    return out | {"why": F.create_map(*why)}


def checked(found: dict[str, Column]) -> dict[str, Column]:
    """An extraction without the periods, regions and addresses that cannot be such."""
    return {name: F.when((_text(c) == "") | _USABLE[KINDS[name]](c), c) if name in CHECKED else c for name, c in found.items()}
