"""A name backend over a named-entity model, for where the model's library is installed."""

from __future__ import annotations

from ..functions.hits import Hit

# --- fixed values: model labels to types ---------------------------------------------------------------------------------
LABELS = {"PERSON": "PERSON", "PER": "PERSON", "ORG": "ORG", "GPE": "LOCATION", "LOC": "LOCATION", "FAC": "LOCATION"}


class SpacyNames:
    """Names from a spaCy pipeline, which each worker loads once; confidence 0.7."""

    def __init__(self, model: str = "en_core_web_sm"):
        self.model, self._nlp = model, None

    def __getstate__(self):
        return {"model": self.model, "_nlp": None}

    def find(self, text: str) -> list[Hit]:
        if self._nlp is None:
            try:
                import spacy
            except ImportError:
                raise RuntimeError("spaCy isn't installed; supply known names instead") from None
            self._nlp = spacy.load(self.model)
        return [Hit(LABELS[e.label_], e.start_char, e.end_char, "spacy", 0.7) for e in self._nlp(text).ents if e.label_ in LABELS]
