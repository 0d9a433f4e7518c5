"""The peak query language: parser and compiler."""
