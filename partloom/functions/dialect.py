"""Two SQL dialects behind one set of primitives.

Scalar rules are written once as SQL expressions. ``SPARK`` renders them for
``functions.expr`` (built-in, inside code generation); ``DUCK`` renders the same rule for
the DuckDB comparison. Patterns stay within what Java and RE2 read alike: no look-around.
"""

from __future__ import annotations


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


class Spark:
    name = "spark"
    string, double = "STRING", "DOUBLE"

    @staticmethod
    def pattern(p: str) -> str:
        assert "'" not in p
        return f"r'{p}'"

    def extract(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.pattern(p)}, {group})"

    def matches(self, x: str, p: str) -> str:
        return f"({x} RLIKE {self.pattern(p)})"

    def replace(self, x: str, p: str, by: str = "") -> str:
        import re

        return f"regexp_replace({x}, {self.pattern(p)}, {self.pattern(re.sub(r'#(\d)', r'$\1', by))})"

    def strip(self, x: str) -> str:
        """Without outer white space: what Java's \\s is, without a pattern."""
        return f"trim(BOTH ' \\t\\n\\u000B\\u000C\\r' FROM {x})"

    def single_blanks(self, x: str) -> str:
        """Runs of white space as one blank; a lone blank is no match, so that most texts pass untouched."""
        return self.replace(x, r"\s{2,}|[\t\n\x0B\f\r]", " ")

    def only(self, x: str, kept: str) -> str:
        """The characters of a class, without all others."""
        return self.replace(x, f"[^{kept}]+")

    def all(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.pattern(p)}, {group})"

    def split(self, x: str, p: str) -> str:
        return f"split({x}, {self.pattern(p)}, -1)"

    def item(self, xs: str, i: int) -> str:
        return f"get({xs}, {i})"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def compact(self, xs: str) -> str:
        return f"array_compact({xs})"

    def distinct_sorted(self, xs: str) -> str:
        return f"array_sort(array_distinct({xs}))"

    def join(self, xs: str, sep: str) -> str:
        return f"concat_ws({lit(sep)}, {xs})"

    def size(self, xs: str) -> str:
        return f"size({xs})"

    def overlap(self, a: str, b: str) -> str:
        return f"arrays_overlap({a}, {b})"

    def map_each(self, xs: str, f: str) -> str:
        return f"transform({xs}, v -> {f})"

    def keep(self, xs: str, f: str) -> str:
        return f"filter({xs}, v -> {f})"

    def contains(self, x: str, y: str) -> str:
        return f"contains({x}, {y})"

    def fmt_g(self, x: str) -> str:
        """C's %g: six significant digits without trailing zeros."""
        once = self.replace(f"format_string('%.6g', {x})", r"(\.[0-9]*?)0+($|e)", "#1#2")
        return self.replace(once, r"\.($|e)", "#1")

    def number(self, x: str) -> str:
        """Double of a text that is a plain number as a whole, else null."""
        return f"CASE WHEN {self.matches(x, r'^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$')} THEN TRY_CAST({x} AS DOUBLE) END"

    def whole(self, x: str) -> str:
        return f"CAST(CAST({x} AS BIGINT) AS STRING)"

    def trunc(self, x: str) -> str:
        return f"(CASE WHEN {x} < 0 THEN ceil({x}) ELSE floor({x}) END)"


class Duck(Spark):
    name = "duck"
    string = "VARCHAR"

    @staticmethod
    def pattern(p: str) -> str:
        return lit(p)

    def matches(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.pattern(p)})"

    def replace(self, x: str, p: str, by: str = "") -> str:
        import re

        return f"regexp_replace({x}, {self.pattern(p)}, {lit(re.sub(r'#(\d)', r'\\\1', by))}, 'g')"

    def strip(self, x: str) -> str:
        return self.replace(x, r"^\s+|\s+$")

    def single_blanks(self, x: str) -> str:
        return self.replace(x, r"\s+", " ")

    def only(self, x: str, kept: str) -> str:
        return self.replace(x, f"[^{kept}]")

    def split(self, x: str, p: str) -> str:
        return f"string_split_regex({x}, {self.pattern(p)})"

    def item(self, xs: str, i: int) -> str:
        return f"list_extract({xs}, {i + 1})"

    def array(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def compact(self, xs: str) -> str:
        return f"list_filter({xs}, lambda v: v IS NOT NULL)"

    def distinct_sorted(self, xs: str) -> str:
        return f"list_sort(list_distinct({xs}))"

    def join(self, xs: str, sep: str) -> str:
        return f"coalesce(array_to_string({xs}, {lit(sep)}), '')"

    def size(self, xs: str) -> str:
        return f"CAST(len({xs}) AS INTEGER)"

    def overlap(self, a: str, b: str) -> str:
        return f"list_has_any({a}, {b})"

    def map_each(self, xs: str, f: str) -> str:
        return f"list_transform({xs}, lambda v: {f})"

    def keep(self, xs: str, f: str) -> str:
        return f"list_filter({xs}, lambda v: {f})"

    def fmt_g(self, x: str) -> str:
        return f"format('{{:g}}', {x})"


SPARK, DUCK = Spark(), Duck()
