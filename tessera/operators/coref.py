"""Coreference in sequence: each chunk sees the resolved chunks before it. Rules are tables: pronouns by kind, and for each kind patterns in order."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, place long, text string, resolved string, n_resolved long, flagged boolean, rolled_back boolean, resolutions array<struct<pronoun: string, antecedent: string>>"


class Rules(NamedTuple):
    #: Finds what may be replaced.
    pronoun: re.Pattern
    #: The kind of each pronoun, in lower case; one without a kind stays.
    kinds: dict[str, str]
    #: For each kind the patterns of what it can stand for: of a text, the first match of the first pattern that has one.
    antecedents: dict[str, tuple[re.Pattern, ...]]


def _rules(kinds: dict[str, str], patterns: dict[str, str], flags: int = 0) -> Rules:
    words = "|".join(sorted((p for k in kinds.values() for p in k.split()), key=len, reverse=True))
    of = {p: k for k, v in kinds.items() for p in v.split()}
    return Rules(re.compile(rf"\b(?:{words})\b", flags), of, {k: tuple(map(re.compile, v.split("\n"))) for k, v in patterns.items()})


# Pronouns by kind, and what stands beside a possible antecedent. A pronoun counts where no letter touches it.
CHINESE = _rules(
    {"person": "他 他们 她 她们", "thing": "它 它们", "near": "这 这些 此人 此事 本 那 那些"},
    {
        "person": "([一-龥]{2,4})(?:先生|女士|教授|博士|院士|总裁|经理|董事长|CEO)\n([一-龥]{2,4})(?:说|道|认为|指出|表示|发现|提出)\n名叫([一-龥]{2,4})\n是([一-龥]{2,4})",
        "thing": "([一-龥]{2,8})(?:技术|方法|模型|算法|系统|方案|理论|方法论)\n([一-龥]{2,8})能够\n([一-龥]{2,8})可以\n名为([一-龥]{2,8})",
        "near": "([一-龥]{2,8})(?:方法|技术|方案|模型|系统)\n([一-龥]{2,6})(?:的)\n这个([一-龥]{2,6})\n这项([一-龥]{2,6})",
    },
)
#: For languages in Latin script: a name behind a title, before a verb of saying, or within a sentence.
LATIN = _rules(
    {"any": "he she it they il elle er sie es"},
    {"any": r"(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? ([^\W\d_]{3,})" "\n" r"([A-ZÀ-Þ][^\W\d_]{2,}) (?:said|says|wrote|dit|sagte|dijo)\b" "\n" r"(?<=[^\W\d_,;] )(?!(?:They|She|Elle|Sie)\b)([A-ZÀ-Þ][^\W\d_]{2,})"},
    re.IGNORECASE,
)


def antecedent(text: str, kind: str, rules: Rules) -> str | None:
    """What a pronoun of *kind* can stand for in *text*."""
    return next((m.group(1) for p in rules.antecedents[kind] if (m := p.search(text))), None)


def circular(found: list[tuple[str, str]]) -> bool:
    """Whether some antecedent is itself a pronoun that was replaced."""
    replaced = {p for p, _ in found}
    return any(a in replaced for _, a in found)


def resolve_document(rows: pd.DataFrame, rules: Rules) -> pd.DataFrame:
    """Rows of one document in order of place.

    A pronoun is replaced by what the chunk itself names first by the rules, or else the nearest chunk before it, as resolved, that names anything. Of each kind only
    the nearest find is kept, so a long document costs no more for each chunk. A chunk with a circle is rolled back; one that grew by half or was
    halved is flagged.
    """
    out: list[tuple] = []
    nearest: dict[str, str] = {}
    for r in rows.sort_values("place").itertuples():
        text = r.text or ""
        own = {k: a for k in rules.antecedents if (a := antecedent(text, k, rules))}
        found: list[tuple[str, str]] = []

        def stand_in(m: re.Match) -> str:
            kind = rules.kinds.get(m.group().lower())
            name = own.get(kind) or nearest.get(kind)  # noqa: B023
            if name:
                found.append((m.group(), name))  # noqa: B023
            return name or m.group()

        new = rules.pronoun.sub(stand_in, text)
        back = circular(found)
        if back:
            new, found = text, []
        odd = bool(text) and not 0.5 <= len(new) / len(text) <= 1.5
        nearest |= {k: a for k in rules.antecedents if (a := antecedent(new, k, rules))}
        out.append((r.doc_id, r.place, r.text, new, len(found), odd, back, [{"pronoun": p, "antecedent": a} for p, a in found]))
    return pd.DataFrame(out, columns=["doc_id", "place", "text", "resolved", "n_resolved", "flagged", "rolled_back", "resolutions"])


def resolve(chunks: DataFrame, rules: Rules = CHINESE) -> DataFrame:
    """SCHEMA of *chunks* (doc_id, place, text); a group is one document's chunks. Null texts count as empty ones."""
    return chunks.select("doc_id", "place", "text").groupBy("doc_id").applyInPandas(lambda rows: resolve_document(rows, rules), SCHEMA)


def inconsistent(resolved: DataFrame) -> DataFrame:
    """(doc_id, pronoun, n, antecedents): pronouns that stand for several things in the chunks of a document; of a chunk the last one counts."""
    each = resolved.select("doc_id", "place", F.posexplode("resolutions").alias("i", "r"))
    last = each.groupBy("doc_id", "place", F.col("r.pronoun").alias("pronoun")).agg(F.max_by("r.antecedent", "i").alias("a"))
    by = last.groupBy("doc_id", "pronoun").agg(F.sort_array(F.collect_set("a")).alias("antecedents"))
    return by.filter(F.size("antecedents") > 1).select("doc_id", "pronoun", F.size("antecedents").cast("long").alias("n"), "antecedents")
