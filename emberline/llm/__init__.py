"""Training-data operators: language, quality, duplicates, mixing, licences, tokens, archives, chats, audio.

Nothing outside this subpackage imports it.
"""
