"""The URL rules that the registered query applies."""

from .url_rules import HostRule, PatternRule

#: The host-and-path rules of the contract.
HOST_RULES = [
    HostRule("block", "com/en/"),
    HostRule("allow", "example.com/en/7"),
    HostRule("allow", "net/de/"),
    HostRule("block", "example.net/de/8"),
    HostRule("block", "org/es/"),
]

PATTERN_RULES = [
    PatternRule("block", r"(?<![a-z0-9])casino(?![a-z0-9])", frozenset({"casino"})),
    PatternRule("block", r"(?<![a-z0-9])porn(?![a-z0-9])", frozenset({"porn"})),
    PatternRule("block", r"(?<![a-z0-9])xxx(?![a-z0-9])", frozenset({"xxx"})),
    PatternRule("block", r"/wp-login\.php(?![a-z0-9])", frozenset({"wp", "login", "php"})),
    PatternRule("block", r"/cgi-bin/", frozenset({"cgi", "bin"})),
    PatternRule("block", r"[?&]sessionid=", frozenset({"sessionid"})),
    PatternRule("allow", r"/help/(?:[^?#]*/)?casino(?![a-z0-9])", frozenset({"help", "casino"})),
]
