"""Folder tree, thematic domains and policies that the engine starts from. All are data: pass your own instead."""

from __future__ import annotations

# Folders, themes with their keywords and aliases, limits.
RAW, PROCESSED, SYNTHESES, OTHER = "Raw Documents", "Processed Documents", "Syntheses", "Autres"
DOMAINS = {
    "Sauvetage Combat": {
        "keywords": ["sauvetage", "combat", "medic", "evacuation", "blessé", "wounded", "casualty", "evac", "combat medic", "first aid", "triage", "санитар", "эвакуация", "раненый", "медик"],
        "aliases": ["medical", "rescue", "evacuation", "combat aid"], "color": "#ff6b6b", "priority": 1,
    },
    "Drones": {
        "keywords": ["drone", "UAV", "UAS", "quadcopter", "surveillance", "reconnaissance", "FPV", "kamikaze", "Bayraktar", "switchblade", "mavic", "дрон", "БПЛА", "квадрокоптер", "разведка"],
        "aliases": ["unmanned", "aerial vehicle", "remote pilot"], "color": "#4ecdc4", "priority": 2,
    },
    "Guerre Electronique": {
        "keywords": ["guerre électronique", "EW", "electronic warfare", "brouillage", "jamming", "radar", "communication", "signal", "frequency", "spectrum", "РЭБ", "радиоэлектронная борьба", "глушение", "радар"],
        "aliases": ["electronic", "signal intelligence", "SIGINT", "ELINT"], "color": "#45b7d1", "priority": 2,
    },
    "Organisation PC": {
        "keywords": ["PC", "poste commandement", "command post", "organisation", "structure", "hiérarchie", "hierarchy", "headquarters", "HQ", "brigade", "battalion", "КП", "командный пункт", "штаб", "организация", "структура"],
        "aliases": ["command", "control", "organization", "military structure"], "color": "#96ceb4", "priority": 2,
    },
    "Formation Personnel": {
        "keywords": ["formation", "entraînement", "training", "personnel", "instruction", "exercice", "drill", "soldier", "military education", "academy", "обучение", "подготовка", "тренировка", "военнослужащий", "академия"],
        "aliases": ["education", "military training", "personnel development"], "color": "#feca57", "priority": 3,
    },
    "Artillerie": {
        "keywords": ["artillerie", "artillery", "canon", "howitzer", "obus", "shell", "bombardement", "bombing", "fire support", "HIMARS", "MLRS", "артиллерия", "пушка", "гаубица", "снаряд", "обстрел", "РСЗО"],
        "aliases": ["fire support", "long range", "rocket", "missile"], "color": "#ff9ff3", "priority": 2,
    },
}
EXTENSIONS = (".pdf", ".docx", ".txt", ".md", ".json")
MOST_BYTES, MOST_OCR_BYTES = 104_857_600, 10_485_760
BATCH_DOCUMENTS, TOP_POINTS, LEAST_POINTS, SIMILAR = 50, 20, 5, 0.8
RELATED, CLUSTERS = 0.7, 10
CHECKS = ("files", "directories", "dependencies", "credentials", "drive", "ocr", "env", "config", "logs", "file_creation")

#: The tree below a root of any name.
TREE = {"Corpus": {RAW: {}, PROCESSED: {**{d: {} for d in DOMAINS}, OTHER: {}}, SYNTHESES: {}, "Archives": {}, "Logs": {}}}

#: What a container's plan may do, and whether uploads carry a description.
POLICIES = {
    RAW: {"upload": True, "update": True, "download": True, "describe": True},
    PROCESSED: {"upload": True, "update": False, "download": True, "describe": False},
    SYNTHESES: {"upload": True, "update": True, "download": False, "describe": False},
}


def domain_rows(domains: dict = DOMAINS) -> list[tuple]:
    """(domain, keywords, aliases, folder_id, color, priority) of a catalogue in the configuration's shape."""
    return [(d, x.get("keywords", []), x.get("aliases", []), x.get("folder_id"), x.get("color"), x.get("priority")) for d, x in domains.items()]
