"""Writers (K1-K10): every sink is a DataFrame write; nothing is collected."""
