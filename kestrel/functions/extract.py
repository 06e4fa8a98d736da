"""Field extraction from a normalized nine-cell record (native expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kestrel.functions.text import WS, jtrim

# The complement of the whitespace class.
NON_WS = r"[^\s\p{Z}\x{FEFF}]"

# The extraction patterns, tried in this order, case-insensitive.
RECIPE_ID_QUOTED = r"(?i)Recipe ID:\s*'([^']+)'"
RECIPE_ID_PLAIN = r"(?i)Recipe ID:\s*([^|,'" + '"' + r"]+)"
RECIPE_ID_WORD = r"(?i)\brecipe_[^|,\s]+"
MATERIAL_NAME = r"(?i)Material Name\s*=\s*([^|]+)"
MATERIAL_ID = r"(?i)Material ID\s*=\s*([0-9]+)"
USER_CELL = r"^(.*?)(?:\s*\(([^)]+)\))?\s*$"
START_VERB = r"(?i)(^|\s)checked out recipe\b"
END_VERBS = (r"(?i)(^|\s)checked in recipe\b|(^|\s)discarded checkout\b"
             r"|(^|\s)updated recipe\b|(^|\s)auto-check in\b")
AUTO_END_VERB = r"(?i)(^|\s)auto-check in\b"


def recipe_id(message: Column) -> Column:
    """First pattern that matches wins, even if its capture trims to ''; then cut at the first '|'.

    A capture is never empty when its pattern matches, so each pattern runs once, and none runs
    on a message without the word."""
    quoted = F.regexp_extract(message, RECIPE_ID_QUOTED, 1)
    plain = F.regexp_extract(message, RECIPE_ID_PLAIN, 1)
    raw = (F.when(F.instr(F.lower(message), "recipe") == 0, F.lit(""))
           .when(quoted != "", quoted).when(plain != "", plain).otherwise(F.regexp_extract(message, RECIPE_ID_WORD, 0)))
    return jtrim(F.substring_index(jtrim(raw), "|", 1))


def recipe_name(type_: Column, label: Column) -> Column:
    return F.when(F.lower(type_) == "recipe", label).otherwise(F.lit(""))


def material_name(message: Column) -> Column:
    return jtrim(F.regexp_extract(message, MATERIAL_NAME, 1))


def material_id(message: Column) -> Column:
    return F.regexp_extract(message, MATERIAL_ID, 1)


def split_user(user: Column) -> Column:
    """``First Rest (login)`` -> struct(name1, name2, username)."""
    m1 = F.regexp_extract(user, USER_CELL, 1)
    login = jtrim(F.regexp_extract(user, USER_CELL, 2))
    name = F.when(m1 != "", jtrim(m1)).otherwise(jtrim(user))
    i = F.instr(name, " ")
    name1 = F.when(i == 0, name).otherwise(jtrim(F.substring(name, F.lit(1), i - 1)))
    name2 = F.when(i == 0, F.lit("")).otherwise(jtrim(F.substr(name, i + 1)))
    return F.struct(name1.alias("name1"), name2.alias("name2"), login.alias("username"))


def action_derived(message: Column) -> Column:
    """First four whitespace-separated words of the message."""
    head = F.regexp_extract(message, rf"^{WS}*({NON_WS}+(?:{WS}+{NON_WS}+){{0,3}})", 1)
    return F.regexp_replace(head, f"{WS}+", " ")


def session_key(username: Column, user_cell: Column, rid: Column, rname: Column) -> Column:
    who = F.when(username != "", username).otherwise(user_cell)
    what = F.when(rid != "", rid).when(rname != "", rname).otherwise(F.lit(""))
    return F.concat(who, F.lit("|"), what)


def _says(message: Column, *phrases: str) -> Column:
    """Whether a phrase occurs at all, any case: a cheap test before the word-boundary pattern."""
    low = F.lower(message)
    hit = F.contains(low, F.lit(phrases[0]))
    for p in phrases[1:]:
        hit = hit | F.contains(low, F.lit(p))
    return hit


def is_start(message: Column) -> Column:
    return _says(message, "checked out recipe") & message.rlike(START_VERB)


def is_end(message: Column) -> Column:
    return _says(message, "checked in recipe", "discarded checkout", "updated recipe", "auto-check in") & message.rlike(END_VERBS)


def is_auto_end(message: Column) -> Column:
    return _says(message, "auto-check in") & message.rlike(AUTO_END_VERB)
