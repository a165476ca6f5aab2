"""Statuses of a journal row, and the numeric codes."""

#: The error codes of the ledger's interface.
CODES = {
    "INITIALIZATION_FAILED": 1001,
    "ROUTING_ERROR": 1010,
    "DUPLICATE_COMMAND": 2001,
    "RECOVERY_FAILED": 3001,
    "SNAPSHOT_SAVE_FAILED": 3002,
    "SNAPSHOT_LOAD_FAILED": 3003,
    "WAL_WRITE_FAILED": 3004,
    "INVALID_ARGUMENT": 4001,
}
ACCEPTED, REJECTED, DUPLICATE, MISROUTED, INVALID, ERROR = "ACCEPTED", "REJECTED", "DUPLICATE", "MISROUTED", "INVALID", "ERROR"
SUCCESS = 200
STATUS_CODE = {
    ACCEPTED: SUCCESS,
    DUPLICATE: CODES["DUPLICATE_COMMAND"],
    MISROUTED: CODES["ROUTING_ERROR"],
    INVALID: CODES["INVALID_ARGUMENT"],
}
