"""Time formats in strptime's notation, compiled on the driver to one pattern and Column arithmetic.

%Y %y %m %b %B %d %e %H %I %M %S %L (milliseconds) %f (fraction, cut to milliseconds) %p %z %Z %s %Q (epoch seconds,
milliseconds) and %%. A format with any other directive is refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .staged import Stage, in_expression
from .text import trimmed
from .timestamps import civil_ms, month_of, zone_ms

#: What each directive matches.
PATTERNS = {
    "Y": r"(\d{4})", "y": r"(\d{2})", "m": r"(\d{1,2})", "b": r"([A-Za-z]{3})", "B": r"([A-Za-z]{3,9})", "d": r"(\d{1,2})", "e": r" ?(\d{1,2})",
    "H": r"(\d{1,2})", "I": r"(\d{1,2})", "M": r"(\d{1,2})", "S": r"(\d{1,2})", "L": r"(\d{1,3})", "f": r"(\d{1,9})", "p": r"([AaPp][Mm])",
    "z": r"(Z|[+-]\d{2}:?\d{2})", "Z": r"([A-Za-z]{1,5})", "s": r"(\d{10})", "Q": r"(\d{13})",
}
FULL_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


@dataclass(frozen=True)
class TimeFormat:
    pattern: str
    #: The directive of each group, in order.
    groups: tuple[str, ...]

    def parse(self, value: Column) -> Column:
        """Epoch milliseconds, or null if the trimmed value doesn't fit the format as a whole."""
        return in_expression(self.stages(), {"time_text": value}, lambda v: v("ts"))

    def stages(self) -> list[Stage]:
        """Stages from `time_text` to `ts`; the pattern is matched once and gives all groups."""
        whole = f"^{self.pattern}\\z"
        groups = lambda text: F.split(F.regexp_replace(text, whole, "|".join(f"${k}" for k in range(1, len(self.groups) + 1))), r"\|")
        return [
            lambda v: {"trimmed": trimmed(v("time_text"))}, lambda v: {"groups": F.when(v("trimmed").rlike(whole), groups(v("trimmed")))},
            lambda v: {"ts": F.when(v("groups").isNotNull(), self._time(v("groups")).cast("bigint"))},
        ]

    def _time(self, given: Column) -> Column:
        last = {code: F.get(given, F.lit(k)) for k, code in enumerate(self.groups)}
        number = lambda code, default=0: last[code].try_cast("bigint") if code in last else F.lit(default).cast("bigint")
        of_kind = lambda *codes: next((c for c in reversed(self.groups) if c in codes), None)
        if (epoch := of_kind("s", "Q")) is not None:
            return number(epoch) * (1000 if epoch == "s" else 1)
        year = {None: F.lit(1970), "Y": number("Y"), "y": number("y") + 2000}[of_kind("Y", "y")]
        month = F.lit(1)
        if (code := of_kind("m", "b", "B")) == "m":
            month = number("m")
        elif code:
            name = F.lower(last[code])
            whole = F.array_position(F.array(*[F.lit(m) for m in FULL_MONTHS]), name)
            month = F.coalesce(F.when(F.length(name) == 3, month_of(name)), F.nullif(whole, F.lit(0)), F.lit(1))
        day, hour = of_kind("d", "e"), of_kind("H", "I")
        h = number(hour) if hour else F.lit(0)
        if "p" in last:
            pm = F.lower(last["p"]) == "pm"
            h = F.when(pm & (h < 12), h + 12).when(~pm & (h == 12), F.lit(0)).otherwise(h)
        small = of_kind("L", "f")
        ms = F.rpad(F.substring(last[small], 1, 3), 3, "0").try_cast("bigint") if small else F.lit(0)
        found = civil_ms(year, month, number(day, 1) if day else F.lit(1), h, number("M"), number("S"), ms)
        return found - zone_ms(last["z"]) if "z" in last else found


def compile_time_format(text: str) -> TimeFormat | None:
    """None if the format has an unknown directive or ends in a lone %."""
    pattern, groups, at = "", [], 0
    while at < len(text):
        char = text[at]
        if char == "%":
            code = text[at + 1 : at + 2]
            if code == "%":
                pattern += "%"
            elif code in PATTERNS:
                pattern += PATTERNS[code]
                groups.append(code)
            else:
                return None
            at += 2
        else:
            pattern += re.escape(char) if char.isascii() and not char.isalnum() and char not in " :" else char
            at += 1
    return TimeFormat(pattern, tuple(groups))
