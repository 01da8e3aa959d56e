"""SQL expressions for two engines from one definition.

Each operator's formula is written once and rendered as Spark SQL, for plans, and as DuckDB SQL,
for the checks. Patterns keep to what both engines' regular expressions share; the word boundary
is spelled out for Spark, whose own knows more letters than ASCII's.
"""

from __future__ import annotations

ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


class Spark:
    name = "spark"

    def pattern(self, p: str) -> str:
        p = p.replace("(?i)", "(?iu)") if not p.isascii() else p
        return "r'" + p.replace(r"\b", ASCII_BOUNDARY).replace("'", r"\x27") + "'"

    def has(self, c, p): return f"({c} rlike {self.pattern(p)})"
    def count(self, c, p): return f"regexp_count({c}, {self.pattern(p)})"
    def first(self, c, p, g=1): return f"regexp_extract({c}, {self.pattern(p)}, {g})"
    def all(self, c, p, g=1): return f"regexp_extract_all({c}, {self.pattern(p)}, {g})"
    def sub(self, c, p, r): return f"regexp_replace({c}, {self.pattern(p)}, '{r}')"
    def split(self, c, p): return f"split({c}, {self.pattern(p)})"
    def keep(self, xs, x, cond): return f"filter({xs}, {x} -> {cond})"
    def each(self, xs, x, expr): return f"transform({xs}, {x} -> {expr})"
    def array(self, *xs): return f"array({', '.join(xs)})"
    def size(self, xs): return f"size({xs})"
    def slice(self, xs, n): return f"slice({xs}, 1, {n})"
    def distinct_size(self, xs): return f"size(array_distinct({xs}))"
    def sorted_distinct(self, xs): return f"array_sort(array_distinct({xs}))"
    def joined(self, xs, by): return f"coalesce(array_join({xs}, '{by}'), '')"
    def sha256(self, c): return f"sha2({c}, 256)"
    def struct(self, **fields): return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
    def distinct(self, xs): return f"array_distinct({xs})"
    def compact(self, xs): return f"filter({xs}, x -> x IS NOT NULL)"
    def concat(self, *xs): return f"concat({', '.join(xs)})"
    def last(self, xs): return f"try_element_at({xs}, -1)"
    def at(self, xs, k): return f"get({xs}, {k})"
    def listagg(self, c, by, cond): return f"array_join(transform(array_sort(collect_list(struct({by} AS k, {c} AS v)) FILTER (WHERE {cond})), x -> x.v), ',')"
    def last_by(self, c, by, cond): return f"max_by({c}, {by}) FILTER (WHERE {cond})"
    def double(self, c): return f"CAST({c} AS DOUBLE)"
    def string(self, c): return f"CAST({c} AS STRING)"
    def group(self, n): return f"${n}"
    def ungrouped(self, c, sign): return f"regexp_replace({c}, r'[{sign}](?=[0-9]{{3}}(?:[.,]|" + chr(92) + "z))', '')"
    def sub_first(self, c, a, b): return f"regexp_replace({c}, r'^([^{a}]*){a}', '$1{b}')"
    def quoted(self, s): return '"' + s.replace(chr(92), chr(92) * 2).replace('"', chr(92) + '"') + '"'
    def sum(self, xs): return f"aggregate({xs}, 0, (a, x) -> a + x)"
    def text(self, s): return "r'" + s.replace("'", "’") + "'"


class Duck:
    name = "duck"

    def pattern(self, p: str) -> str: return "'" + p.replace("'", r"\x27") + "'"
    def has(self, c, p): return f"regexp_matches({c}, {self.pattern(p)})"
    def count(self, c, p): return f"CAST(len(regexp_extract_all({c}, {self.pattern(p)})) AS INTEGER)"
    def first(self, c, p, g=1): return f"regexp_extract({c}, {self.pattern(p)}, {g})"
    def all(self, c, p, g=1): return f"regexp_extract_all({c}, {self.pattern(p)}, {g})"
    def sub(self, c, p, r): return f"regexp_replace({c}, {self.pattern(p)}, '{r}', 'g')"
    def split(self, c, p): return f"regexp_split_to_array({c}, {self.pattern(p)})"
    def keep(self, xs, x, cond): return f"list_filter({xs}, lambda {x}: {cond})"
    def each(self, xs, x, expr): return f"list_transform({xs}, lambda {x}: {expr})"
    def array(self, *xs): return f"[{', '.join(xs)}]"
    def size(self, xs): return f"CAST(len({xs}) AS INTEGER)"
    def slice(self, xs, n): return f"list_slice({xs}, 1, {n})"
    def distinct_size(self, xs): return f"CAST(len(list_distinct({xs})) AS INTEGER)"
    def sorted_distinct(self, xs): return f"list_sort(list_distinct({xs}))"
    def joined(self, xs, by): return f"coalesce(array_to_string({xs}, '{by}'), '')"
    def sha256(self, c): return f"sha256({c})"
    def struct(self, **fields): return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"
    def distinct(self, xs): return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"
    def compact(self, xs): return f"list_filter({xs}, lambda x: x IS NOT NULL)"
    def concat(self, *xs): return f"list_concat({', '.join(xs)})"
    def last(self, xs): return f"({xs})[-1]"
    def at(self, xs, k): return f"({xs})[{k} + 1]"
    def listagg(self, c, by, cond): return f"coalesce(string_agg({c}, ',' ORDER BY {by}) FILTER (WHERE {cond}), '')"
    def last_by(self, c, by, cond): return f"arg_max({c}, {by}) FILTER (WHERE {cond})"
    def double(self, c): return f"CAST({c} AS DOUBLE)"
    def string(self, c): return f"CAST({c} AS VARCHAR)"
    def group(self, n): return chr(92) + str(n)
    def sub_first(self, c, a, b): return f"regexp_replace({c}, '^([^{a}]*){a}', '" + chr(92) + f"1{b}')"

    def ungrouped(self, c, sign):
        # Without a look ahead, a pass takes every second of adjoining groups.
        for _ in range(2):
            c = f"regexp_replace({c}, '[{sign}]([0-9]{{3}})([.,]|$)', '" + chr(92) + "1" + chr(92) + "2', 'g')"
        return c
    def quoted(self, s): return "'" + s.replace("'", "''") + "'"
    def sum(self, xs): return f"CAST(coalesce(list_sum({xs}), 0) AS INTEGER)"
    def text(self, s): return "'" + s.replace("'", "’") + "'"


SPARK, DUCK = Spark(), Duck()
