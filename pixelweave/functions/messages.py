"""Messages in English and German, looked up with fallbacks: language, English, the key itself."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGES = {
    "en": {"io": "could not read or write", "decode": "the image data is damaged", "encode": "the image could not be encoded", "invalid_input": "invalid input", "unsupported": "not supported", "font": "font problem", "icon": "icon problem", "unknown_format": "unknown image format", "zero_size": "width and height must be positive", "crop_bounds": "the crop lies outside the image", "quality_range": "quality must be 1 to 100", "size_mismatch": "the images differ in size", "no_pixels": "no visible pixels", "empty_text": "the text is empty", "ico_size": "icons have at most 256 pixels a side"},
    "de": {"io": "Lesen oder Schreiben fehlgeschlagen", "decode": "die Bilddaten sind beschädigt", "encode": "das Bild konnte nicht kodiert werden", "invalid_input": "ungültige Eingabe", "unsupported": "nicht unterstützt", "font": "Schriftproblem", "icon": "Symbolproblem", "unknown_format": "unbekanntes Bildformat", "zero_size": "Breite und Höhe müssen positiv sein", "crop_bounds": "der Ausschnitt liegt außerhalb des Bildes", "quality_range": "Qualität muss 1 bis 100 sein", "size_mismatch": "die Bilder sind verschieden groß", "no_pixels": "keine sichtbaren Pixel", "empty_text": "der Text ist leer", "ico_size": "Symbole haben höchstens 256 Pixel je Seite"},
}


def active_lang(environ: dict[str, str] | None = None, override: str = "PIXELWEAVE_LANG") -> str:
    """The first of the override, LANG and LC_ALL that names a known language by its first letters; else English."""
    env = os.environ if environ is None else environ
    for name in (override, "LANG", "LC_ALL"):
        if (code := env.get(name, "").lower()[:2]) in MESSAGES:
            return code
    return "en"


def tr(key: str, lang: str | None = None) -> str:
    return MESSAGES.get(lang or active_lang(), {}).get(key) or MESSAGES["en"].get(key, key)


def tr_column(key: Column, lang: str) -> Column:
    table = lambda code: F.create_map(*(F.lit(x) for kv in MESSAGES.get(code, {"": ""}).items() for x in kv))
    return F.coalesce(F.try_element_at(table(lang), key), F.try_element_at(table("en"), key), key)
