from folioscan.rules.indonesian import INDONESIAN
from folioscan.rules.model import FileRule, RuleSet, Topic

__all__ = ["INDONESIAN", "FileRule", "RuleSet", "Topic"]
