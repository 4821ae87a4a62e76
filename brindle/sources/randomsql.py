"""Random queries of the dialect over given columns, the same for the same seed: for trying the rewriter and comparing engines."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

# Functions and operators by what they take and give; # stands for an expression of the kind that its letter names (n number, s string, d date, b truth value).
FORMS = {
    "n": "#n + #n|#n - #n|#n * #n|#n / #n|#n % #n|#n DIV #n|- #n|ABS(#n)|CEIL(#n)|FLOOR(#n)|SIGN(#n)|ROUND(#n, 2)|TRUNCATE(#n, 1)|MOD(#n, 7)|SQRT(ABS(#n))|LEAST(#n, #n)|GREATEST(#n, #n)|LENGTH(#s)|CHAR_LENGTH(#s)|ASCII(#s)|INSTR(#s, 'a')|LOCATE('1', #s)|STRCMP(#s, #s)|YEAR(#d)|MONTH(#d)|DAYOFMONTH(#d)|DAYOFWEEK(#d)|WEEK(#d, 3)|TO_DAYS(#d)|DATEDIFF(#d, #d)|CAST(#s AS SIGNED)|IFNULL(#n, 0)|COALESCE(#n, #n)|IF(#b, #n, #n)|CASE WHEN #b THEN #n ELSE #n END|#s + #n",
    "s": "UPPER(#s)|LOWER(#s)|REVERSE(#s)|TRIM(#s)|LEFT(#s, 3)|RIGHT(#s, 2)|SUBSTRING(#s, 2, 4)|CONCAT(#s, '-', #s)|CONCAT_WS('/', #s, #s)|REPLACE(#s, 'a', 'bb')|LPAD(#s, 8, '*')|RPAD(#s, 8, '+')|REPEAT(#s, 2)|INSERT(#s, 2, 1, 'x')|HEX(#s)|ELT(2, #s, #s)|IFNULL(#s, 'none')|IF(#b, #s, #s)|DATE_FORMAT(#d, '%Y-%m-%d')|SUBSTRING_INDEX(#s, ' ', 1)|QUOTE(#s)",
    "d": "DATE_ADD(#d, INTERVAL 3 DAY)|DATE_SUB(#d, INTERVAL 1 MONTH)|LAST_DAY(#d)|DATE(#d)|IF(#b, #d, #d)",
    "b": "#n > #n|#n <= #n|#n = #n|#n <> #n|#s = #s|#s < #s|#s LIKE '%a%'|#d >= #d|#n IS NULL|#s IS NOT NULL|#b AND #b|#b OR #b|NOT #b|#b XOR #b|#n BETWEEN #n AND #n|#n IN (1, 2, #n)|#n <=> #n|#b IS TRUE",
}
_CONSTANTS = {"n": ("0", "1", "-3", "2.5", "1000"), "s": ("'a'", "'12abc'", "''", "'Zürich'"), "d": ("DATE '2020-02-29'", "'1999-12-31'"), "b": ("TRUE", "FALSE")}
_KINDS = {"int": "n", "number": "n", "string": "s", "date": "d", "time": "d", "bool": "b"}


@dataclass
class Corpus:
    """Queries over one table. ``columns``: what each holds, as ``dialect.kinds_of`` has it. ``key`` makes orders complete."""

    table: str
    key: str
    columns: dict[str, str]
    seed: int = 0
    depth: int = 3
    pick: random.Random = field(init=False)

    def __post_init__(self) -> None:
        self.pick = random.Random(self.seed)

    def expression(self, kind: str, depth: int | None = None) -> str:
        depth = self.depth if depth is None else depth
        if depth <= 0 or self.pick.random() < 0.15:
            own = [c for c, k in self.columns.items() if _KINDS.get(k) == kind]
            return self.pick.choice(own) if own and self.pick.random() < 0.75 else self.pick.choice(_CONSTANTS[kind])
        first, *rest = self.pick.choice(FORMS[kind].split("|")).split("#")
        return "(" + first + "".join(self.expression(r[0], depth - 1) + r[1:] for r in rest) + ")"

    def query(self) -> str:
        fields = ", ".join(f"{self.expression(self.pick.choice('nnsd'))} AS field{i}" for i in range(1, self.pick.randint(2, 4)))
        order = f"field1{self.pick.choice(('', ' DESC'))}, {self.key}"
        return f"SELECT {self.key}, {fields} FROM {self.table} WHERE {self.expression('b')} ORDER BY {order} LIMIT {self.pick.randint(1, 10)}"

    def queries(self, n: int) -> list[str]:
        return [self.query() for _ in range(n)]
