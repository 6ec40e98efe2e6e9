"""Text helpers: trimming, percent coding, slugs, ids and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The characters that count as white space at the ends of a text.
_WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not just blanks."""
    return F.btrim(text, F.lit(_WHITE_SPACE))


def strip_or_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def percent_decode(text: Column) -> Column:
    """Decode %XX. A plus sign stays, and so does a percent sign that starts no code."""
    guarded = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(F.replace(guarded, F.lit("+"), F.lit("%2B")))


def slugify(text: Column) -> Column:
    """Blank to underscore, then percent-encode all but letters, digits and ``_.-~/()``."""
    coded = F.url_encode(F.translate(text, " ", "_"))
    # Where form encoding and path encoding differ.
    for have, want in (("*", "%2A"), ("%7E", "~"), ("%2F", "/"), ("%28", "("), ("%29", ")")):
        coded = F.replace(coded, F.lit(have), F.lit(want))
    return coded


def unslugify(slug: Column) -> Column:
    return percent_decode(F.translate(slug, "_", " "))


def clean_id(text: Column) -> Column:
    return percent_decode(F.translate(strip(text), "_", " "))


def name_from_url(url: Column) -> Column:
    """Page name in a wiki URL: the ``title`` parameter of an edit link, else the last segment."""
    title = F.nullif(F.regexp_extract(url, r"\A[^?#]*\?(?:[^#]*?&)?title=([^&#]*)", 1), F.lit(""))
    decoded = percent_decode(F.translate(title, "+", " "))
    last = F.translate(F.substring_index(url, "/", -1), "_", " ")
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit(None).cast("string")).otherwise(
        F.when(url.contains("action=edit"), decoded).otherwise(last)
    )


def player_link(player_uid: Column) -> Column:
    return F.concat(F.lit("/players/"), slugify(player_uid), F.lit("/"))


def team_link(
    team_id: Column,
    date_from: Column | None = None,
    date_to: Column | None = None,
    highlight: Column | None = None,
) -> Column:
    """Team page path; ``from``, ``to`` and ``hl`` follow in that order when given."""
    path = F.concat(F.lit("/teams/"), slugify(team_id), F.lit("/"))
    params = []
    for name, value in (("from", date_from), ("to", date_to), ("hl", highlight)):
        if value is not None:
            shown = F.nullif(value.cast("string"), F.lit(""))
            params.append(F.concat(F.lit(f"{name}="), shown))
    if not params:
        return path
    # concat_ws skips nulls, so absent parameters leave no trace
    query = F.concat_ws("&", *params)
    return F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), query))


def flag_path(flag_name: Column) -> Column:
    return F.when(F.coalesce(flag_name, F.lit("")) == "", F.lit("-")).otherwise(
        F.concat(F.lit("/img/f/"), slugify(flag_name), F.lit(".svg"))
    )


def resolve_query(query: Column) -> Column:
    """Search box text to a page path: ``player:x``, ``team:x`` or a bare team id."""
    is_player = query.startswith("player:")
    value = F.regexp_replace(query, r"\A(?:player:|team:)", "")
    return F.when(F.coalesce(query, F.lit("")) == "", F.lit("/")).otherwise(
        F.when(is_player, player_link(value)).otherwise(team_link(value))
    )
