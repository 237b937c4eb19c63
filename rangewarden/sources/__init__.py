"""Sources: log lines, live messages, lists, invented logs."""
