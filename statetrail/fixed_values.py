"""Seed vocabulary of the repair workflow."""

# These names, their order and these edges decide results.

# (name, is_initial, is_terminal); ids are the positions, from 1
STATES = [
    ("neutral", True, False),
    ("registered", False, False),
    ("assigned", False, False),
    ("dispatched", False, False),
    ("start of service", False, False),
    ("end of service", False, False),
    ("reported", False, True),
    ("parts missing", False, False),
]

# ids are the positions, from 1
SIGNALS = [
    "customer call",
    "assign",
    "dispatch",
    "arrive",
    "parts missing",
    "parts picked ok",
    "parts picked failed",
    "finished work ok",
    "finished work failed",
    "customer notification",
    "time interval",
]

# (signal, from state, to state)
EDGES = [
    ("customer call", "neutral", "registered"),
    ("assign", "registered", "assigned"),
    ("dispatch", "assigned", "dispatched"),
    ("arrive", "dispatched", "start of service"),
    ("parts missing", "start of service", "parts missing"),
    ("parts picked ok", "parts missing", "start of service"),
    ("parts picked failed", "parts missing", "assigned"),
    ("finished work ok", "start of service", "end of service"),
    ("finished work failed", "start of service", "parts missing"),
    ("customer notification", "end of service", "reported"),
    ("time interval", "parts missing", "assigned"),
]

# the usual order of a repair, with the labels shown for it
LIFECYCLE = [
    ("neutral", "Received"),
    ("registered", "Registered"),
    ("assigned", "Assigned"),
    ("dispatched", "Dispatched"),
    ("start of service", "Service Started"),
    ("parts missing", "Parts Missing"),
    ("end of service", "Service Complete"),
    ("reported", "Reported"),
]

UNASSIGNED = "Unassigned"
SIGNAL_OK = "finished work ok"
SIGNAL_FAILED = "finished work failed"
SLA_STATES = ("parts missing", "assigned")
SLA_HOURS = 24.0
LIFECYCLE_STEP_HOURS = 2

ERROR_WORDS = ("missing", "failed", "error")
URGENT_WORDS = ("missing", "failed")
SUCCESS_STATES = ("reported", "end of service")
RATE_SUCCESS_ABOVE = 80
RATE_ERROR_BELOW = 60
WAIT_ERROR_ABOVE_HOURS = 24
WAIT_WARNING_ABOVE_HOURS = 8
