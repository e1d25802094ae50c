"""The dialect: text to tokens, tokens to statements, statements to DataFrame plans."""
