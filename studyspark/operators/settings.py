"""Settings with defaults, type checks and limits."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class Settings:
    model: str = ""
    num_questions: int = 12
    guidance: str = ""

    LEAST, MOST = 1, 50

    @classmethod
    def of(cls, found: object) -> Settings:
        """Values of the right type, whatever else is there; numbers held between the limits."""
        got = found if isinstance(found, dict) else {}
        kept = {f.name: got[f.name] for f in fields(cls) if type(got.get(f.name)) is type(f.default)}
        if "num_questions" in kept:
            kept["num_questions"] = max(cls.LEAST, min(cls.MOST, kept["num_questions"]))
        return cls(**kept)

    def changed(self, changes: dict) -> Settings:
        return Settings.of(asdict(self) | {k: v for k, v in changes.items() if type(v) is type(getattr(self, k, None))})
