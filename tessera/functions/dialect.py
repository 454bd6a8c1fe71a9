"""The few places where Spark SQL and the oracle's SQL differ."""

from __future__ import annotations


class Dialect:
    def __init__(self, spark: bool) -> None:
        self.spark = spark

    def table(self, name: str) -> str:
        return "{" + name + "}" if self.spark else name

    def div(self, a: str, b: str) -> str:
        """Integer division that truncates."""
        return f"(({a}) {'div' if self.spark else '//'} ({b}))"

    def mod(self, a: str, b: str) -> str:
        """Remainder of 0 or more."""
        return f"(((({a}) % ({b})) + ({b})) % ({b}))"

    def rint(self, a: str) -> str:
        """Half to even."""
        return f"rint({a})" if self.spark else f"round_even({a}, 0)"

    def whole(self, a: str, kind: str = "BIGINT") -> str:
        return f"CAST({self.rint(a)} AS {kind})"

    def exact_mean(self, a: str) -> str:
        """The mean of numbers of at most a million, in whole 1E-12 steps: it doesn't depend on the order of rows, as a sum of doubles does."""
        return f"(CAST(sum(CAST({self.whole(f'({a}) * 1E12')} AS DECIMAL(20, 0))) AS DOUBLE) / count({a}) / 1E12)"

    def min_by(self, value: str, *keys: str) -> str:
        return f"min_by({value}, struct({', '.join(keys)}))" if self.spark else f"arg_min({value}, ({', '.join(keys)}))"

    def max_by(self, value: str, *keys: str) -> str:
        return f"max_by({value}, struct({', '.join(keys)}))" if self.spark else f"arg_max({value}, ({', '.join(keys)}))"

    def xor(self, a: str, b: str) -> str:
        return f"(({a}) ^ ({b}))" if self.spark else f"xor({a}, {b})"

    def shr(self, a: str, b: str) -> str:
        return f"shiftright({a}, {b})" if self.spark else f"(({a}) >> ({b}))"

    def shl(self, a: str, b: str) -> str:
        return f"shiftleft({a}, {b})" if self.spark else f"(({a}) << ({b}))"

    def joined(self, value: str, order: str) -> str:
        """Texts of a group in one, by commas, in an order."""
        return f"listagg({value}, ',') WITHIN GROUP (ORDER BY {order})" if self.spark else f"string_agg({value}, ',' ORDER BY {order})"

    def numbers(self, first: str, last: str) -> str:
        """A list of whole numbers, both ends included."""
        return f"sequence({first}, {last})" if self.spark else f"range({first}, {last} + 1)"

    def explode(self, values: str) -> str:
        return f"explode({values})" if self.spark else f"unnest({values})"


SPARK, ORACLE = Dialect(True), Dialect(False)
