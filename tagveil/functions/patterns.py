"""The catalogue of sensitive values that have a form of their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from tagveil.functions import text

# Postal codes of the states and the capital's district.
STATES = (
    "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|"
    "MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC"
)
# Words that stand before a document's number.
DOCUMENT_LABELS = "invoice|inv|document|doc|order|reference|ref|statement|confirmation|policy|claim|customer|member"
_LABEL_END = r"\.?\s*(?:number|no|num|#|id)?\.?\s*[:#]?\s*"


@dataclass(frozen=True)
class Pattern:
    """``before`` is matched but not part of the value; ``after`` must follow without being matched."""

    type: str
    prefix: str
    value: str
    before: str = ""
    after: str = ""
    ignore_case: bool = False
    valid: Callable[[Column], Column] | None = None
    #: A string that every match holds; texts without it are not searched.
    needs: str | None = None
    #: What every match begins with, in ASCII texts: a cheap look ahead, before bounds are looked at.
    starts: str | None = None

    @property
    def flags(self) -> str:
        return "(?isU)" if self.ignore_case else "(?sU)"

    @property
    def parts(self) -> str:
        """Regex with two groups: what is matched before the value, and the value."""
        return f"{self.flags}({self.before})({self.value}){self.after}"

    @property
    def ascii_parts(self) -> str:
        """The same for texts in ASCII only, where the faster ASCII classes mean the same."""
        plain = self.parts.replace("U)", ")", 1)
        return plain.replace(")", f")(?={self.starts})", 1) if self.starts else plain

    @property
    def found(self) -> str:
        """Regex that is true of texts with the pattern."""
        return f"{self.flags}{self.before}{self.value}{self.after}"

    @property
    def walk(self) -> str:
        """Regex whose successive matches are (what comes before the value, value): group lengths give offsets.

        Held to the end of the last match: without that, the search behind the last value would
        start anew at every character, in time that grows with the square of the text.
        """
        return f"{self.flags}\\G(.*?{self.before})({self.value}){self.after}"


# The accepted forms, in the order that numbers are given out.
CATALOGUE = (
    Pattern("email", "EMAIL", r"\b[\w.+-]++@[\w-]++\.[\w.-]+\b", needs="@"),
    Pattern("ssn", "SSN", r"\b\d{3}-\d{2}-\d{4}\b", needs="-", starts=r"\d\d\d-"),
    Pattern("ein", "EIN", r"\b\d{2}-\d{7}\b", needs="-", starts=r"\d\d-"),
    Pattern("phone", "PHONE", r"(?<!\d)(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}(?!\d)", starts=r"[\d(+]"),
    Pattern("iban", "IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", starts=r"[A-Z][A-Z]\d"),
    Pattern("credit_card", "CARD", r"\b(?:\d[ -]?){13,19}\b", valid=text.luhn_valid, starts=r"\d[\d -]"),
    Pattern("routing", "ROUTING", r"\b\d{9}\b", valid=text.routing_valid, starts=r"\d\d\d\d"),
    Pattern("url", "URL", r"\bhttps?://[^\s<>\"')]+", needs="://", starts="http"),
    Pattern("account", "ACCOUNT", r"[0-9A-Za-z][0-9A-Za-z\-]{3,}", r"\b(?:account|acct)\b" + _LABEL_END, ignore_case=True, valid=text.has_digit, starts="acc"),
    Pattern("doc_number", "DOCUMENT", r"[0-9A-Za-z][0-9A-Za-z\-]{2,}", rf"\b(?:{DOCUMENT_LABELS})\b" + _LABEL_END, ignore_case=True, valid=text.has_digit, starts="[cdimoprs][elnortu]"),
    Pattern("zip", "ZIP", r"\b\d{5}-\d{4}\b", needs="-", starts=r"\d{5}-"),
    Pattern("zip", "ZIP", r"\d{5}(?:-\d{4})?", rf"\b(?:{STATES})\s+", r"\b", starts=r"[A-Z][A-Z]\s"),
    Pattern("place", "PLACE", rf"\b(?:{STATES})\b", after=r"(?=\s+\d{5}(?:-\d{4})?\b)", starts=r"[A-Z][A-Z]\s"),
)
MONEY = Pattern("money", "AMOUNT", r"\$\s?\d[\d,]*(?:\.\d{2})?\b", needs="$")


def catalogue(include_money: bool = False, custom: tuple[Pattern, ...] = ()) -> tuple[Pattern, ...]:
    """The built-in forms, amounts of money if asked for, and a user's own forms behind them."""
    return CATALOGUE + (MONEY,) * include_money + custom
