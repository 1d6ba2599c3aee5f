"""Header tags, moves and clocks of a game record, as native expressions.

Each extractor is one pass over the record inside the JVM; nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the record format.
TAG_PATTERN = r'\[(\w+)\s+"([^\n]*?)"\]'
TAGGED_PATTERN = r'(?s)^.*"\]'
WHITE_CLOCK_PATTERN = r"(\d+)\. \S+ \{\[%clk ([0-9:]+(?:\.[0-9]+)?)\]\}"
BLACK_CLOCK_PATTERN = r"(\d+)\.\.\. \S+ \{\[%clk ([0-9:]+(?:\.[0-9]+)?)\]\}"

# A clock of either colour; starts at the last digit of the move number. No match of one colour can
# start inside one of the other, so one pass finds what the two patterns above find in two.
CLOCK_PATTERN = r"\d\.(?:\.\.)?+ \S++ \{\[%clk ([0-9:]++(?:\.[0-9]++)?+)\]\}"

# A line whose text from its first '[' on ends in ']' loses that part and its line end. Anchored at
# the line start and possessive, so that the one long line of moves is walked once.
TAG_LINE_PATTERN = r"(?md)^([^\[\n]*+)\[[^\n]*+(?<=\])\n"

_HMS_PATTERN = r"^([01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d$"
_WHOLE_NUMBER = r"^\d+$"

EST_OFFSET_SECONDS = 5 * 3600
EST_DAY_BREAK_SECONDS = 19 * 3600


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


# -- header tags ---------------------------------------------------------------------------


def tagged_part(pgn: Column) -> Column:
    """The text up to its last ``"]``, with which every tag ends: no tag lies beyond, and the moves are not walked."""
    return F.regexp_extract(pgn, TAGGED_PATTERN, 0)


def tag_names(pgn: Column) -> Column:
    """Names of all tags, the last tag first."""
    return F.reverse(_all(tagged_part(pgn), TAG_PATTERN, 1))


def tag_values(pgn: Column) -> Column:
    return F.reverse(_all(tagged_part(pgn), TAG_PATTERN, 2))


def tag(names: Column, values: Column, name: str) -> Column:
    """Value of one tag, NULL when absent; the last one wins when a tag repeats."""
    return F.get(values, (F.array_position(names, F.lit(name)) - 1).cast("int"))


def tag_map(names: Column, values: Column) -> Column:
    """All tags as a map, keeping the last value of a repeated tag."""
    pairs = F.arrays_zip(names.alias("name"), values.alias("value"))
    return F.map_from_entries(F.filter(pairs, lambda pair, i: F.array_position(names, pair["name"]) == i + 1))


# -- moves ---------------------------------------------------------------------------------


def _is_move(word: Column) -> Column:
    """A word without '.', not opening a comment, that holds a letter or '='."""
    return ~word.contains(".") & ~word.startswith("{") & (word.contains("=") | word.rlike(r"\p{L}"))


def moves(pgn: Column) -> Column:
    """Words of the text below the tag lines that are moves.

    Splitting and testing words is several times faster than one pattern with look-around.
    """
    return F.filter(F.split(F.regexp_replace(pgn, TAG_LINE_PATTERN, "$1"), r"\s+"), _is_move)


def move_text(own_moves: Column) -> Column:
    """Moves as one compact string, the form in which they travel."""
    return F.array_join(own_moves, " ")


def moves_of_text(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def every_second(items: Column, start: int) -> Column:
    return F.filter(items, lambda _, i: i % 2 == start)


def castling_side(own_moves: Column) -> Column:
    """Side castled to; a check sign on the move hides it, and the queen side is looked for first."""
    return (
        F.when(F.array_contains(own_moves, "O-O-O"), "queenside")
        .when(F.array_contains(own_moves, "O-O"), "kingside")
        .otherwise("none")
    )


def count_containing(own_moves: Column, mark: str) -> Column:
    return F.size(F.filter(own_moves, lambda m: m.contains(mark))).cast("bigint")


# -- clocks --------------------------------------------------------------------------------


def clock_list(pgn: Column, pattern: str) -> Column:
    """Pairs of move number and clock text for one colour, from one pass over the text."""
    return F.transform(
        _all(pgn, pattern, 0),
        lambda m: F.struct(
            F.substring_index(m, ".", 1).alias("move_no"),
            F.substring_index(F.substring_index(m, "%clk ", -1), "]", 1).alias("clk"),
        ),
    )


def clock_times(pgn: Column, pattern: str) -> Column:
    return _all(pgn, pattern, 2)


def clock_marks(pgn: Column) -> Column:
    """Moves with a clock, from the last digit of the move number on, of both colours in one pass."""
    return _all(pgn, CLOCK_PATTERN, 0)


def marks_of(marks: Column, side: str) -> Column:
    """Marks of White (``5. Nf3 ...``) or of Black (``5... Nc6 ...``)."""
    return F.filter(marks, lambda m: (m.substr(3, 1) == " ") == F.lit(side == "white"))


def mark_clock(mark: Column) -> Column:
    return F.regexp_extract(mark, CLOCK_PATTERN, 1)


def last_clock(marks: Column) -> Column:
    """Seconds on the last of the marks."""
    return clock_seconds(F.when(F.size(marks) > 0, mark_clock(F.element_at(marks, -1))))


def clock_seconds(clock: Column) -> Column:
    """``H:MM:SS(.f)`` as seconds."""
    part = F.split(clock, ":")
    return (
        F.try_element_at(part, F.lit(1)).try_cast("double") * 3600
        + F.try_element_at(part, F.lit(2)).try_cast("double") * 60
        + F.try_element_at(part, F.lit(3)).try_cast("double")
    )


def last_clock_seconds(clocks: Column) -> Column:
    return clock_seconds(F.when(F.size(clocks) > 0, F.element_at(clocks, -1)))


# -- wall-clock header times ---------------------------------------------------------------


def day_seconds(hms: Column) -> Column:
    """``H:M:S`` as seconds of the day, NULL when it is no time of day."""
    part = F.split(hms, ":")
    seconds = part[0].cast("bigint") * 3600 + part[1].cast("bigint") * 60 + part[2].cast("bigint")
    return F.when(hms.rlike(_HMS_PATTERN), seconds)


def _two(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def hms_text(seconds_of_day: Column) -> Column:
    return F.concat_ws(
        ":",
        _two(F.floor(seconds_of_day / 3600)),
        _two(F.floor(F.pmod(seconds_of_day, F.lit(3600)) / 60)),
        _two(F.pmod(seconds_of_day, F.lit(60))),
    )


def est_seconds(utc_seconds_of_day: Column) -> Column:
    return F.pmod(utc_seconds_of_day - EST_OFFSET_SECONDS, F.lit(86400))


def est_time(hms: Column) -> Column:
    seconds = day_seconds(hms)
    return F.when(seconds.isNotNull(), hms_text(est_seconds(seconds)))


def est_date(date: Column, est_seconds_of_day: Column) -> Column:
    """UTC date moved back a day for starts after 19:00:00 local, which lie on the day before."""
    return F.when(est_seconds_of_day > EST_DAY_BREAK_SECONDS, F.date_sub(date, 1)).otherwise(date)


def header_date(text: Column) -> Column:
    return F.try_to_date(text, "yyyy.MM.dd")


def elapsed_seconds(start_seconds: Column, end_seconds: Column) -> Column:
    return F.pmod(end_seconds - start_seconds, F.lit(86400))


# -- time controls -------------------------------------------------------------------------


def _control_parts(control: Column) -> tuple[Column, Column]:
    """Base and increment seconds; both NULL unless the text is ``base`` or ``base+increment``."""
    part = F.split(control, r"\+")
    base = part[0].try_cast("bigint")
    increment = F.when(F.size(part) == 1, F.lit(0).cast("bigint")).when(F.size(part) == 2, F.get(part, F.lit(1)).try_cast("bigint"))
    known = base.isNotNull() & increment.isNotNull()
    return F.when(known, base), F.when(known, increment)


def time_control_label(control: Column) -> Column:
    base, increment = _control_parts(control)
    minutes = F.floor(base / 60)
    seconds = F.pmod(base, F.lit(60))
    base_text = (
        F.when((minutes > 0) & (seconds > 0), F.concat(minutes.cast("string"), F.lit("m "), seconds.cast("string"), F.lit("s")))
        .when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m")))
        .otherwise(F.concat(seconds.cast("string"), F.lit("s")))
    )
    increment_text = F.concat(F.greatest(increment, F.lit(0)).cast("string"), F.lit("s"))

    part = F.split(control, "/")
    divisor = F.get(part, F.lit(1))
    is_daily = (F.size(part) == 2) & part[0].rlike(_WHOLE_NUMBER) & divisor.rlike(_WHOLE_NUMBER)
    days = F.try_divide(part[0].try_cast("double"), F.try_divide(divisor.try_cast("double"), F.lit(86400.0)))
    # The label texts.
    unknown = F.concat(F.lit("Unrecognized format: "), control)
    return (
        F.when(control.isNull() | (control == ""), "Invalid time control")
        .when(control == "-", "Unlimited")
        .when(is_daily, F.concat(F.round(days, 1).cast("string"), F.lit(" day(s) per move")))
        .when(control.contains("/"), unknown)
        .when(base.isNull(), unknown)
        .otherwise(F.concat(base_text, F.lit(" + "), increment_text))
    )


def time_control_seconds(control: Column) -> Column:
    """Base plus one increment; daily, unlimited and unknown controls have none."""
    base, increment = _control_parts(control)
    return (base + F.greatest(increment, F.lit(0))).cast("double")


def time_left(result: Column, last_mover: Column, other: str, last_clock: Column, control_seconds: Column) -> Column:
    """Seconds on a player's clock at the end; ``other`` is the last mover that leaves this player flagged."""
    flagged = (result == "timeout") | ((result == "timevsinsufficient") & (last_mover == other))
    return F.when(flagged, F.lit(0.0)).otherwise(F.coalesce(last_clock, control_seconds))


def time_left_ratio(left: Column, control_seconds: Column) -> Column:
    return F.when(control_seconds > 0, left / control_seconds)
