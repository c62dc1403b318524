"""Functions of one text: character classes, scans, containers, duplication, reports."""
