"""Part of tallyfold."""
