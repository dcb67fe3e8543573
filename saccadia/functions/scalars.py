"""Column expressions on single rows. Missing values are NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from saccadia import schemas as S


def clip(value: Column, low: float, high: float) -> Column:
    """Limit to ``[low, high]``; NULL stays NULL (greatest/least would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def on_screen(x: Column, y: Column) -> Column:
    return x.between(0, S.SCREEN_WIDTH) & y.between(0, S.SCREEN_HEIGHT)


def whole_number(token: Column) -> Column:
    """Digits only; everything else, signs included, is NULL."""
    return F.when(token.rlike("^[0-9]+$"), token.try_cast("double"))


def plain_decimal(token: Column) -> Column:
    """Digits with at most one dot; signs and exponents give NULL."""
    return F.when(token.rlike("^[0-9]*[.]?[0-9]*$") & token.rlike("[0-9]"), token.try_cast("double"))


def cast_columns(columns: list[str], types: dict[str, str]) -> list[Column]:
    """Typed projection; text that does not parse becomes NULL."""
    return [F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in columns]


def first_match(cases: list[tuple[Column, object]]) -> Column:
    """Value of the first case that holds, else NULL."""
    return F.coalesce(*[F.when(condition, F.lit(value)) for condition, value in cases])


def colour_name(colour: Column) -> Column:
    return first_match([(colour == code, name) for code, name in S.COLOUR_NAMES.items()])


def is_patient(group: Column) -> Column:
    return F.coalesce(group == "PATIENT", F.lit(False)).cast("int")


def excel_date(serial: Column) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), serial.cast("int"))


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def mean_of_eyes(left: Column, right: Column) -> Column:
    """Mean of the eyes that have a value."""
    return F.when(left.isNotNull() & right.isNotNull(), (left + right) / 2).otherwise(F.coalesce(left, right))


def side_of(value: Column, centre: float, low: str, high: str, middle: str = "middle",
            tolerance: float = S.CENTRE_TOLERANCE) -> Column:
    """Label of one coordinate relative to a centre."""
    off = value - F.lit(centre)
    return F.when(F.abs(off) < tolerance, middle).when(off > 0, high).when(off < 0, low)


def move_1d(start: Column, end: Column, low: str, high: str) -> Column:
    return side_of(end - start, 0, low, high, "no_direction")


def saccade_direction_1d() -> Column:
    return move_1d(F.col("start_x"), F.col("end_x"), "left", "right")


def saccade_direction_2d() -> Column:
    """Horizontal and vertical part joined as ``x_y``; a still part is left out."""
    x = move_1d(F.col("start_x"), F.col("end_x"), "left", "right")
    y = move_1d(F.col("start_y"), F.col("end_y"), "down", "up")
    return (F.when(x.isNull() | y.isNull(), None)
            .when(y == "no_direction", x).when(x == "no_direction", y)
            .otherwise(F.concat_ws("_", x, y)))


def saccade_end_area(end_x: Column) -> Column:
    return F.when(end_x >= 1080, "right").when(end_x <= 840, "left").when(end_x.isNotNull(), "middle")


def centre_area(x: Column, y: Column, vertical: str = "reference") -> Column:
    """Area of a point around the screen centre.

    ``vertical='reference'`` gives a purely vertical offset no label; ``'fixed'`` labels it ``up`` or ``down``.
    """
    ax = side_of(x, S.CENTRE_X, "left", "right")
    ay = side_of(y, S.CENTRE_Y, "down", "up")
    only_vertical = ay if vertical == "fixed" else F.lit(None).cast("string")
    return (F.when(ax.isNull() | ay.isNull(), None)
            .when(ay == "middle", ax)
            .when(ax == "middle", only_vertical)
            .otherwise(F.concat_ws("_", ax, ay)))


def gaze_direction() -> Column:
    """Direction of a fixation made while the red stimulus shows."""
    shown = (F.col("colour") == S.RED) & (F.col("event") == "EFIX")
    return (F.when(shown & (F.col("x") > 1100), "right").when(shown & (F.col("x") < 820), "left")
            .when(shown, "middle"))


# Scan-path classes per experiment as (event, colour or None for any, label); the first match counts.
_TWO_STEP = [("FIXPOINT", S.RED, "Stimulus"), ("FIXPOINT", S.WHITE, "Middle stimulus"),
             ("EFIX", S.RED, "Fixations - Post stimulus"), ("EFIX", S.WHITE, "Fixations - Pre stimulus")]
_WHITE_STIMULUS = [("EFIX", None, "Fixations"), ("FIXPOINT", S.WHITE, "Stimulus")]
SCAN_PATH_CLASSES = {
    "ANTI_SACCADE": _TWO_STEP,
    "REACTION": _TWO_STEP,
    "FITTS_LAW": [("FIXPOINT", S.RED, "Stimulus"), ("EFIX", None, "Fixations")],
    "SMOOTH_PURSUITS": _WHITE_STIMULUS,
    "SHAPES": _WHITE_STIMULUS,
    "EVIL_BASTARD": [("EFIX", None, "Fixations"), ("FIXPOINT", S.BLUE, "Stimulus - Blue"),
                     ("FIXPOINT", S.RED, "Stimulus - Red"), ("FIXPOINT", None, "Stimulus")],
}


def scan_path_class(experiment: str) -> Column:
    cases = []
    for event, colour, name in SCAN_PATH_CLASSES.get(experiment, []):
        hit = F.col("event") == event
        cases.append((hit if colour is None else hit & (F.col("colour") == colour), name))
    return first_match(cases) if cases else F.lit(None).cast("string")
