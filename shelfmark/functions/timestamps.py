"""Column functions that read timestamps of many notations, without Python in the hot path.

``canonical_notation`` and ``wall_seconds`` yield what a notation fixes; ``resolve_wall_clock`` turns wall-clock seconds and a
zone id into the one instant they fix, or null where the zone has that time twice or never.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Minutes east of UTC of the zone abbreviations that are read.
ABBREVIATION_MINUTES = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "HDT": -540,
    "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "JST": 540,
    "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480,
}

# Month names by language, January first.
MONTHS = (
    "january february march april may june july august september october november december",
    "jan feb mar apr may jun jul aug sep oct nov dec",
    "januar februar märz april mai juni juli august september oktober november dezember",
    "jänner februar marz april mai juni juli august sept okt nov dez",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "janv fevrier mars avr mai juin juil aout sept oct nov decembre",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia",
    "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    "январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь",
)
MONTH_NUMBER = {name: i + 1 for line in MONTHS for i, name in enumerate(line.split())}

_ZONE = r"(Z|(?:GMT|UTC)?[+-]\d{2}:?\d{2}|(?:GMT|UTC)?[+-]\d{2}|[A-Z]{2,4}|[A-Z][A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+)?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?"
_AMPM = r"\s*([AaPp]\.?[Mm]\.?)?"
_DOW = r"(?:\p{L}{2,9}\.?,? +)?"
_MONTH = r"(\p{L}{3,12}\.?)"
#: notation -> (pattern, the canonical ``y|m|d|h|min|s|ampm|zone`` in terms of its groups)
NOTATIONS = {
    "pdf": (r"^D:(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})?(?:(Z)(?:00'?00'?)?|([+-]\d{2})'?(\d{2})?'?)?$", "$1|$2|$3|$4|$5|$6||$7$8$9"),
    "compact": (r"^(\d{4})(\d{2})(\d{2})(?:[T ]?(\d{2})(\d{2})(\d{2})|[T ](\d{2})(\d{2}))(?:[.,]\d+)?" + _ZONE + "$", "$1|$2|$3|$4$7|$5$8|$6||$9"),
    "iso": (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?:[T ]| +)" + _CLOCK + _AMPM + r"\s*" + _ZONE + "$", "$1|$3|$4|$5|$6|$7|$8|$9"),
    "numeric": (r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}),?[T ]+" + _CLOCK + _AMPM + r"\s*" + _ZONE + "$", "$4|$1|$3|$5|$6|$7|$8|$9"),
    "day_first": (r"^" + _DOW + r"(\d{1,2})\.? (?:de )?" + _MONTH + r",? (?:de )?(\d{4}),? +" + _CLOCK + _AMPM + r"\s*" + _ZONE + "$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    "month_first": (r"^" + _DOW + _MONTH + r" (\d{1,2}),? (\d{4}),? +" + _CLOCK + _AMPM + r"\s*" + _ZONE + "$", "$3|$1|$2|$4|$5|$6|$7|$8"),
    "ctime": (r"^\p{L}{2,9}\.? " + _MONTH + r" +(\d{1,2}) " + _CLOCK + r" (?:" + _ZONE + r" )?(\d{4})$", "$7|$1|$2|$3|$4|$5||$6"),
    "cjk": (r"^(\d{4})年(\d{1,2})月(\d{1,2})日 ?(\d{1,2})(?:[:：时時]|点)(\d{1,2})(?:分|(?::(\d{2}))?)(?:(\d{2})秒)?$", "$1|$2|$3|$4|$5|$6$7||"),
}


def _lookup(table: dict[str, int], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def _int(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{1,4}$"), text.cast("int"))


def canonical_notation(value: Column, day_first: Column) -> Column:
    """``notation|y|m|d|h|min|s|ampm|zone`` of the first notation that fits, ``epoch|seconds`` or null.

    ``day_first`` says how all-number dates with the year last are read; where it is null they aren't.
    """
    v = F.trim(F.regexp_replace(value, r"[\p{Z}\s]+", " "))
    out = F.when(v.rlike(r"^\d{9,10}$"), F.concat(F.lit("epoch|"), v))
    out = out.when(v.rlike(r"^(?:\d{13}|\d{16})$"), F.concat(F.lit("epoch|"), F.substring(v, 1, 10)))
    for name, (pattern, groups) in NOTATIONS.items():
        read = F.regexp_replace(v, pattern, groups)
        if name == "numeric":
            swapped = F.regexp_replace(v, pattern, groups.replace("$1|$3", "$3|$1"))
            read = F.when(day_first, swapped).when(~day_first, read)
        out = out.when(v.rlike(pattern), F.concat(F.lit(name + "|"), read))
    return out


def wall_seconds(parts: Column) -> Column:
    """Wall-clock seconds, as if in UTC, of a split canonical notation; null where date or time is impossible."""
    half = F.lower(F.substring(F.get(parts, F.lit(7)), 1, 1))
    h24 = _int(F.get(parts, F.lit(4)))
    h = F.when(half == "", h24).when(h24.between(1, 12), (h24 % 12) + F.when(half == "p", 12).otherwise(0))
    s = F.when(F.get(parts, F.lit(6)) == "", 0).otherwise(_int(F.get(parts, F.lit(6))))
    month = F.coalesce(_int(F.get(parts, F.lit(2))), _lookup(MONTH_NUMBER, F.regexp_replace(F.lower(F.get(parts, F.lit(2))), r"\.$", "")))
    at = F.try_make_timestamp(_int(F.get(parts, F.lit(1))), month, _int(F.get(parts, F.lit(3))), F.when(h < 24, h), _int(F.get(parts, F.lit(5))), F.when(s < 60, s), F.lit("UTC"))
    return F.when(F.get(parts, F.lit(0)) == "epoch", F.get(parts, F.lit(1)).cast("bigint")).otherwise(F.unix_seconds(at))


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that later expressions may use many times over at the cost of one evaluation.

    The generator is a fence: the optimiser neither inlines the expressions into what follows nor pushes filters on
    them below, either of which would copy large parsing expressions into each other again and again.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def fixed_offset_seconds(zone: Column) -> Column:
    """Seconds east of UTC of ``Z``, ``+hh:mm``, ``GMT+hh:mm`` or an abbreviation; null for anything else."""
    n = F.regexp_replace(zone, r"^(?:GMT|UTC)(?=[+-])", "")
    digits = F.regexp_replace(n, r"[+:\-]", "")
    hh, mm = _int(F.substring(digits, 1, 2)), F.when(F.length(digits) > 2, _int(F.substring(digits, 3, 2))).otherwise(0)
    sign = F.when(n.startswith("-"), -1).otherwise(1)
    numeric = F.when((hh <= 14) & (mm < 60), sign * (hh * 3600 + mm * 60))
    return F.when(n.rlike(r"^[+-]\d{2}:?(?:\d{2})?$"), numeric).otherwise(_lookup({k: v * 60 for k, v in ABBREVIATION_MINUTES.items()}, n))


def offset_at(utc_s: Column, zone: Column) -> Column:
    """Seconds east of UTC of ``zone`` at an instant."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(utc_s), zone)) - utc_s


def resolve_wall_clock(local_s: Column, zone: Column) -> Column:
    """The only instant that wall-clock seconds have in ``zone``; null where there are two or none.

    The offsets a day before and after are the only ones that can be in force; each gives a candidate instant,
    which counts if the zone really has that offset then.
    """
    before, after = offset_at(local_s - 86400, zone), offset_at(local_s + 86400, zone)
    one, two = local_s - before, local_s - after
    first, other = offset_at(one, zone) == before, offset_at(two, zone) == after
    return F.when(before == after, F.when(first, one)).when(first & ~other, one).when(other & ~first, two)


def wall_clock_estimate(local_s: Column, zone: Column) -> Column:
    """An instant for every wall-clock time, also for doubled or skipped ones; for counting violations only."""
    return local_s - offset_at(local_s - offset_at(local_s, zone), zone)
